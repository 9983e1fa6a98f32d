"""gridcast.sinks"""
