"""gridcast.learn"""
