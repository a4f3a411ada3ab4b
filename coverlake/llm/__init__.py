"""Operations for preparing training data: ten Spark operators over document, page and conversation tables.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
