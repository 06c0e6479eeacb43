"""The pipeline against its stages' own rules by brute force, on the smallest tables and on one of edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from turnledger.llm import mixing
from turnledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def form(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")


def after_rules(rows):
    """(doc_id, text, source) of the rows that the rules keep, without their frequent lines."""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, form(line)].add(text)
    frequent = {k for k, v in holders.items() if len(v) > 20 and len(v) > 0.02 * len(texts[k[0]])}
    out = []
    for i, text, host in rows:
        words, lines = WORD.findall(text or ""), (text or "").split("\n")
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen = Counter(grams)
        repeats = len({k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(8)})
        gone = sum(len(WORD.findall(line)) for line in lines if (host, form(line)) in frequent)
        if len(words) >= 20 and 100 * repeats <= 30 * len(words) and gone <= 0.5 * len(words):
            out.append((i, "\n".join(line for line in lines if (host, form(line)) not in frequent), host))
    return out


def after_dedup(rows, percent):
    """Of equal texts the smallest doc_id, then of groups of near-duplicates the smallest; null ids come last and have no links."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    left, sets = list(first.values()), {}
    for i, text, _ in left:
        w = WORD.findall(text.translate(LOW))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    links = {i: [j for j in sets if i == j or any(near(a, b) for a in sets[i] for b in sets[j])] for i in sets}
    label = {i: i for i in sets}
    while (new := {i: min(label[j] for j in links[i]) for i in sets}) != label:
        label = new
    return [r for r in left if r[0] is None or label[r[0]] == r[0]]


def wanted(spark, rows):
    """What the pipeline returns: a row a use, with the library's ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = after_dedup(after_rules(rows), 80)
    docs = spark.createDataFrame(left, "doc_id long, text string, source string")
    uses = {r.doc_id: r.taken // r["size"] for r in mixing.taken_words(spark, docs).collect()}
    out = Counter()
    for i, text, _ in left:
        ids = library.encode(text, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False).encode()
        out[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(said).hexdigest()] += uses[i]
    return +out


def prose(rng, n):
    return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    rng = np.random.default_rng(12)
    rows = [(k, f"{prose(rng, 40)}\nAll rights  reserved {k}\n{prose(rng, 30)}", "a") for k in range(26)]
    rows += [(30 + k, prose(rng, 60), ["b", None, "c"][k % 3]) for k in range(12)]
    base = prose(rng, 100).split()
    for k, edits in enumerate(([], [45], [20, 70], [12, 33, 84])):  # 1.0, 0.90, 0.81 and 0.73 of the windows shared
        rows.append((60 + k, " ".join("x" if n in edits else w for n, w in enumerate(base)), "b"))
    rows += [(70, rows[30][1].replace(" ", "\t ", 5), "a"), (31, rows[27][1], "b"), (32, rows[28][1], "c"), (32, rows[28][1], "c")]
    rows += [(80, None, "a"), (81, "", None), (82, " \n ", "b"), (83, "too short", "c"), (84, "again and again " * 30, "a")]
    rows += [(None, prose(rng, 40), "c"), (None, None, None), (85, "é Σ İ ఼̔ <|endoftext|> " + prose(rng, 6000), "c")]
    return rows


def test_pipeline_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == wanted(spark, rows)


def test_pipeline_on_edge_cases(spark, edge_rows, tmp_path):
    """Nulls in every column, copies, repeated rows, frequent lines, a long text, and columns whose names clash."""
    own = [(i, t, "xx" if i else None, s, None if t is None else len(t), "r", 1, "x", 2.0) for i, t, s in edge_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, digest string, size double"
    spark.createDataFrame(own, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = wanted(spark, edge_rows)
    assert got == want
    ids = {r[0] for r in got}
    assert {60, 63} <= ids and not ids & {61, 62, 70, 80, 81, 82, 83, 84}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered(spark):
    names = set(entry.queries())
    assert {"pipeline", *QUERIES} <= names and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "mixing", "bpe"]


#: Columns of each query and their types, in the order of the contract.
CONTRACT = {
    "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3_quality_fm": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_quality_rules": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean",
    },
    "op9_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_keep_their_contract(spark, name):
    """The query functions themselves: one row a document, the columns of the contract, and over_limit by its definition."""
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = df.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name == "op2_token_counts":
        assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    if name in ("op3_quality_fm", "op5_toxicity"):
        least = 0.3 if name == "op3_quality_fm" else 0.5
        assert all(r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in rows)
