import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, digest string, label int, words string, rank int, shard int, n int, id long, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, odd white space, nulls, empty and long texts, repeated rows; clashing columns."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = prose(rng, 60)
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(100 + k, texts[k % 3].replace(" ", "  \t" if k % 2 else "\n", 3)) for k in range(9)]
    for k in range(8):
        words = texts[5].split()
        words[k * 3] = "changed"
        out.append((200 + k, " ".join(words)))
    out += [(300 + k, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20 + k)}") for k in range(5)]
    out += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "One"), (405, "Ünï çödé 😀 'tis <|endoftext|> ok İ Σ"), (406, "x" * 3000), (407, "ab " * 20_000)]
    out += [(500, texts[7] + " " + texts[7]), (None, texts[2]), (None, None), (23, texts[23]), (408, f"{prose(rng, 9)}\n{'#$% ' * 8}\n{'#$% ' * 8}")]
    sources = ["a", "b", None, "c"]
    return [(i, t, "xx" if i else None, sources[(i or 0) % 4], None if t is None else len(t), 1, "d", 1, "w", 1, 1, 1, 7, "r") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(docs):
    """One row a doc_id, none of them null."""
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])
