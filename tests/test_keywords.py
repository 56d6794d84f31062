"""Keywords of documents in any script."""

import re

from fathomline import plans
from fathomline.operators import rca

SF = "/root/testdata/sf0.001"
WORDS = ["the", "idiot", "of", "token"]


def test_borders_are_those_of_any_script(spark):
    texts = ["éthe", "the\u0301", "The été", "«the»", "of_", "of٣", "日of", "été of, token", "", "x\nTOKEN\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = [r[0] for r in df.orderBy("id").select(rca.keywords(df.text, WORDS)).collect()]
    assert found == [[], [], ["the"], ["the"], [], [], [], ["of", "token"], [], ["token"]]


def test_every_document_has_its_row(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["found"] for r in plans.queries()["rca_18_keywords"](spark, SF).collect()}
    assert any(not t.isascii() for t in docs.values())
    assert got == {i: [w for w in WORDS if re.search(rf"(?<!\w){w}(?!\w)", t.lower())] for i, t in docs.items()}
