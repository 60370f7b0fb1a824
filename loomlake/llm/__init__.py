"""Operations of a training-data pipeline: quality, dedup, extraction, mixing, sharding, tokens.

Nothing outside this subpackage imports it; ``loomlake.llm.queries`` lists its registered queries.
"""
