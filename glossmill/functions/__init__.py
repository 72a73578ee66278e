"""glossmill.functions"""
