"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

language     documents whose language can't be told go
near_copies  one document of each group of near copies stays (five-word shingles, similarity 0.8 or more): the smallest id
benchmark    documents with a passage of the benchmark go
personal     personal data becomes surrogates; n_chars follows the text
mixing       sources are brought to their target weights; a document appears once for each copy taken, numbered by `copy`

Defined results, by stage: null, empty and letterless texts go in the first; of rows that repeat an id and its text one stays
in the second, and rows without an id are matched like others and stay only where their group has none with one; null ids,
sources and other columns go through all stages; an empty table gives empty ones; other columns stay as they are, whatever
their names, but for n_chars, which follows the text, and `copy`, which the last stage sets.
"""

from __future__ import annotations

from quillstone.llm import common, decontaminate, jaccard_join, langid, mixing, pii

#: zstandard's output sizes, near-copy groups and keyed surrogates have no SQL form.
ORACLE_SQL = None


def language(spark, docs, sf_dir):
    return langid.accepted(docs, langid.fit(docs))


def near_copies(spark, docs, sf_dir):
    return jaccard_join.representatives(docs)


def benchmark(spark, docs, sf_dir):
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal(spark, docs, sf_dir):
    return pii.rewritten(docs, pii.session_key(spark))


def mix(spark, docs, sf_dir):
    return mixing.mixed(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal", personal), ("mixing", mix)]


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.persisted(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
