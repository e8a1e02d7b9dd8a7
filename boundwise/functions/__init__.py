"""boundwise.functions"""
