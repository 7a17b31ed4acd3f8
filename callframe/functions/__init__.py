"""callframe.functions"""
