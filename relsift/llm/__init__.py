"""Operations of a training-data pipeline: filtering, deduplication, decontamination, mixing.

Nothing outside this subpackage imports it.
"""
