"""boundwise.plans"""
