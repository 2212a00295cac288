import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows and columns named like internal ones."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000)) + "."
    texts = [None, "", " \n\t ", "one", long, long, "Ünïcode ñandú “quoted” 你好 <|endoftext|>", "a\x00b"]
    rows = [(i if i != 3 else None, t, "en", "s", None if t is None else len(t), i, "x", 0.5) for i, t in enumerate(texts)]
    rows.append(rows[4])
    kind = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, score double"
    return spark.createDataFrame(rows, kind)


@pytest.fixture
def none(odd):
    return odd.limit(0)
