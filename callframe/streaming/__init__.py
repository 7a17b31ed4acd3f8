"""callframe.streaming"""
