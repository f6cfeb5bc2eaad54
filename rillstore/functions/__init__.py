"""rillstore.functions"""
