"""Keys beside words, counting strings and marked examples."""

import math
import random
import re
import string

import duckdb
import pytest

from assayer.llm import secrets, sql
from assayer.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS, written
from tools.verify import rows_of

KEY = "q8Zp2LxV7mKd4RtY9wBn3HaJ6sFg1TcE5uXo0QiN"


def test_keys_beside_allowed_words_are_found(spark):
    heads = ["aws_secret_access_key=", "my-service-account-key=", "/home/app/keys/", "x-", "0123456789", "my_example_access_key=", "/var/EXAMPLE/"]
    texts = [f"é {h}{KEY} end" for h in heads]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        begin, stop = text.index(KEY), text.index(KEY) + len(KEY)
        spans = got[i].secret_spans
        assert any(x["start"] <= begin + 4 and stop - 4 <= x["end"] for x in spans), text
    redacted = secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(KEY[4:-4] not in r.text for r in redacted)


def test_words_and_examples_stay(spark):
    texts = ["/usr/local/share/documents/page2", "some-long-title-with-many-words-v2", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "/a" * 50_000 + "1", "/ab" * 50_000 + "/1"]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert found.where("size(secret_spans) > 0").count() == 0
    names = ["getElementsByClassName2", "SomeLongCamelCaseWords/page12", "/internationalisation18/chapter7_draft3", "Ab" * 50_000 + "1", "ab/" * 50_000 + "c9"]
    found = secrets.scan(spark.createDataFrame(list(enumerate(names)), "doc_id bigint, text string"))
    assert found.where("size(secret_spans) > 0").count() == 0


ALPHABETS = {"hex": "0123456789abcdef", "upper": string.ascii_uppercase + string.digits, "mixed": string.ascii_letters + string.digits}


def entropy(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


@pytest.mark.parametrize("kind", list(ALPHABETS))
def test_short_random_keys_are_found(spark, kind):
    rng = random.Random(4)
    keys = ["".join(rng.choice(ALPHABETS[kind]) for _ in range(20)) for _ in range(1500)]
    keys = [k for k in keys if re.search("[0-9]", k) and re.search("[A-Za-z]", k)]
    found = secrets.scan(spark.createDataFrame([(i, f"a {k} b") for i, k in enumerate(keys)], "doc_id bigint, text string"))
    got = {r.doc_id for r in found.where("size(secret_spans) > 0").collect()}
    assert got == {i for i, k in enumerate(keys) if entropy(k) >= secrets.LIMITS[kind] - 1e-9 and not re.search(secrets.ALLOWED[3], k)}
    assert len(keys) - len(got) <= 0.02 * len(keys)


def test_spans_beside_words_agree_with_sql(spark, tmp_path):
    rng = random.Random(9)
    heads = ["aws_secret_access_key=", "/home/app/keys/", "0123456789", "x-EXAMPLE-", "é a/b/c/d/", "some-long-title-words-", "EXAMPLE", "=", ""]
    key = lambda: "".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randrange(5, 60)))
    texts = [" ".join(rng.choice(heads) + key() + rng.choice(["", "EXAMPLE", "EXAMPLEKEY", "/abcdefghij/" + key()]) for _ in range(4)) for _ in range(150)]
    rows = [(i, t, *[None] * (len(DOCUMENTS) - 2)) for i, t in enumerate([*texts, texts[0], None, "", key() * 300])]
    folder = written(tmp_path, {"documents": [*rows, rows[3]]})
    frame = QUERIES["op8_secret_scan"](spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    answer = db.execute(sql.SECRETS)
    columns, want = [c[0] for c in answer.description], answer.fetchall()
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, want)
    assert sum("entropy" in str(r) for r in want) > 100
