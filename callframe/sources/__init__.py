"""callframe.sources"""
