"""rillstore.plans"""
