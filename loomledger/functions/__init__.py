"""Column expressions: functions from Column to Column, no DataFrames and no Python UDFs unless stated."""
