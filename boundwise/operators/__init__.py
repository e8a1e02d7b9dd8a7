"""boundwise.operators"""
