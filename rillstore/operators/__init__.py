"""rillstore.operators"""
