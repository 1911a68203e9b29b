import random

from tests import models
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.chunk import chunks, sections, split_sentences
from docloom.operators.normalize import normalize_markdown
from docloom.functions.text import trim


def fuzz(n, seed, pieces):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


PIECES = ["a", "word ", "\n", "\n\n", "\n\n\n", "# H", "## Two x", "\n# ", "```", "\n```\n", "<br>", "<b>", "</P>", " ", "　", "  ", "\r\n", "é日𝄞", "#", "- x", "\x0b", " \n", "<P class='x'>"]
LONG = ["alpha beta. ", "Gamma? ", "dé日𝄞", "x" * 300, "\n\n", "\n# Head one\n", "\n## Head\n", "! ", "y" * 900 + " ", "\n", ". "]


def column(spark, texts, c):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", c(F.col("t")).alias("o")).collect())]


def test_normalize_equals_model(spark):
    texts = fuzz(400, 1, PIECES) + ["", " ", "\n\n", "```\n\n\n\n\nx\n```"]
    assert column(spark, texts, normalize_markdown) == [models.normalize(t) for t in texts]


def test_normalize_quirks(spark):
    assert column(spark, ["x\n## H\n\ny"], normalize_markdown) == ["x\n\n## H\n\n\ny\n"]
    assert column(spark, ["a" * 20000 + "\n" + "b\n" * 9000], normalize_markdown) == ["a" * 20000 + "\n" + "b\n" * 8999 + "b\n"]


def test_chunks_equal_model(spark):
    texts = fuzz(300, 2, LONG) + ["", "   ", "# only", "x" * 5000, "é" * 3000, "日" * 2000 + ". " + "a" * 100]
    got = column(spark, texts, chunks)
    for t, g in zip(texts, got, strict=True):
        assert [(c["id"], c["text"], c["section"], c["char_count"], c["token_estimate"]) for c in g] == models.chunks(t)


def test_fragments_are_bounded_and_lossless(spark):
    texts = ["日本. " * 900, "a" * 2200, "a" * 2201, "é" * 1100 + "b"]
    for t, g in zip(texts, column(spark, texts, split_sentences), strict=True):
        assert "".join(g) == t and all(len(x.encode()) <= 2200 for x in g)


def test_pages_of_sections(spark):
    md = "<!-- page 1 -->\n# A\n\nx\n\n<!-- page 2 -->\n# B\n\ny"
    got = column(spark, [md], lambda c: sections(trim(c)))[0]
    assert [(s["heading"], s["page_start"], s["page_end"]) for s in got] == [(None, 1, 2), ("A", 2, 3), ("B", 3, 3)]


def test_titles_and_predicates(spark):
    texts = ["## x\n # Real \n# Two", "ab\n<!-- c -->\nlong line", "", "# \nx"]
    assert column(spark, texts, T.title) == ["Real", None, None, None]
    assert column(spark, texts, T.document_title) == ["Real", "long line", None, None]
    assert column(spark, texts, T.image_title) == ["Real", "ab", None, "#"]
    assert column(spark, ["- x", "1.x", "1 x", "12345. y", "x"], T.is_list_item) == [True, True, False, True, False]
    assert column(spark, ["####### x", "##", "# x", "#x"], T.is_heading) == [False, True, True, False]


def test_fold(spark):
    assert column(spark, ["ﬁne — “q” ¡ café´s ½ ​x́ `y` ß™ �"], T.fold_page_text) == ['fine -- "q" ? cafes ? x y ss(TM) ?']
