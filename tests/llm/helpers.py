"""Tables and comparisons shared by the tests of the corpus operators."""

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables")

#: Columns of documents, and some named like what operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __t string, __w int, __h long, term string, fp long, label string, root int, grp int, h int, low string"


def documents(spark, *texts, first=0, lang=None, ids=None):
    rows = [(ids[k] if ids else first + k, t, lang[k] if lang else None, "s", None if t is None else len(t), "x", 1, 2, "y", 3, "z", 4, 5, 6, "q") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def as_folder(path, **tables):
    """Writes tables the way the driver's folders hold them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
