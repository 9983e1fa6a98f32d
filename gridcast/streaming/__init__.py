"""gridcast.streaming"""
