"""rillstore.streaming"""
