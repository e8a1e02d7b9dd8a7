"""boundwise.sources"""
