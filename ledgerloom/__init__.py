"""Chain data (blocks, transactions, receipts, contract logs) as Spark tables.

An append-only changelog of decoded messages is the only source of truth;
every table, balance and watermark is a DataFrame derived from it.
"""
