"""callframe.plans"""
