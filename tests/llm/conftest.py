import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash."""

    def build(rows, clash=()):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2 :]), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame([(*r, *[7] * len(clash)) for r in full], DOCS + "".join(f", {c} long" for c in clash))
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def on_disk(tmp_path_factory):
    """A folder with the given tables, as the queries read them."""

    def write(**tables):
        d = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write


@pytest.fixture(scope="session")
def duck_rows():
    """Rows of check SQL over the tables of a folder, as a frame."""
    import glob

    import duckdb

    def run(sf_dir, sql):
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            at = f"{f}/*.parquet" if os.path.isdir(f) else f
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
        return con.execute(sql).df()

    return run
