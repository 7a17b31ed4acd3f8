"""callframe.operators"""
