"""rillstore.sources"""
