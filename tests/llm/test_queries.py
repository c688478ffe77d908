"""The operators' queries: against SQL where there is some, else against brute force."""

import collections
import hashlib
import re

import pytest

from arborweft.llm import oracle, queries

SF = "/root/testdata/sf0.001"
ORACLE = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.queries()[name], ORACLE[name])


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def run(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def count_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_leaks_are_the_planted_passages(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(d, i) for d, t, _ in documents for i, p in items if p in (t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SF).collect()}
    assert want
    assert want <= got
    for d, i in got - want:  # anything else must share a long stretch with the item
        text, item = next(t for k, t, _ in documents if k == d).lower(), next(p for k, p in items if k == i).lower()
        assert any(item[k : k + 60] in text for k in range(len(item) - 59))


def test_mix_by_groups_meets_targets(spark, documents, monkeypatch):
    """Many shards in many groups: a source still comes near its target."""
    from arborweft.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 3)
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), rows_per_shard=2, block_words=8).collect()
    source = {d: s for d, _, s in documents}
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(t - 8 * len(documents) / 2 / len(target) <= taken[s] <= t + 8 for s, t in target.items())
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.02


def test_mix_meets_targets(spark, documents):
    rows = run(spark, "op2_mix_sources")
    assert len(rows) == len(documents)
    by = collections.defaultdict(list)
    for d, t, s in documents:
        assert rows[d]["size"] == count_words(t)
        assert 0 <= rows[d]["taken"] <= 3 * rows[d]["size"]
        by[s].append(rows[d])
    total = sum(r["size"] for r in rows.values())
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert {r["source_size"] for r in v} == {sum(r["size"] for r in v)}
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 128
    assert rows == run(spark, "op2_mix_sources")


def test_repeats_equal_brute_force(spark, documents):
    n = 200
    seen = collections.Counter(b[i : i + n] for _, t, _ in documents for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    got = run(spark, "op3_suffix_array_dedup")
    for d, t, _ in documents:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert tuple(got[d])[1:] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def brute_components(rows, n, percent):
    sets, inverted, up = {}, collections.defaultdict(list), {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        up[d] = d

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        shared = collections.Counter(o for g in sets[d] for o in inverted[g])
        for o, k in shared.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                a, b = sorted((find(d), find(o)))
                up[b] = a
        for g in sets[d]:
            inverted[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_components_equal_brute_force(spark, documents):
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in run(spark, "op4_ngram_jaccard_join").items()}
    assert got == brute_components([x[:2] for x in documents], 3, 90)


def test_token_counts_equal_plain_viterbi(spark, documents):
    from arborweft.llm.tokens import MARK, load_pieces

    pieces, byte = load_pieces(queries.MODEL)
    longest = max(map(len, pieces))

    def tokens(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            found = [(best[end - 1][0] + size * byte, -(-best[end - 1][1] + size))]
            found += [(best[b][0] + pieces[word[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in pieces]
            best.append(max(found))
        return -best[-1][1]

    got = run(spark, "op5_token_counts")
    known = {}
    for d, t, _ in documents:
        words = (t or "").encode().split()
        for w in words:
            if w not in known:
                known[w] = tokens(MARK + w.decode())
        assert (got[d]["n_pretokens"], got[d]["n_tokens"]) == (len(words), sum(map(known.__getitem__, words)))


def test_token_counts_come_near_the_models_own(spark, documents):
    from arborweft.llm.tokens import is_unigram, own_counts

    with open(queries.MODEL, "rb") as f:
        assert not is_unigram(f.read())
    assert is_unigram(b"\x12\x02\x18\x01")
    assert not is_unigram(b"\x0a\x01x\x12\x02\x18\x02")
    got = run(spark, "op5_token_counts")
    own = own_counts([t or "" for _, t, _ in documents], queries.MODEL)
    counted = sum(r["n_tokens"] for r in got.values())
    assert abs(counted / sum(own) - 1) < 0.05
    print(counted, sum(own), counted / sum(own))


def test_shards_are_even_and_gapless(spark, documents):
    import zlib

    rows = run(spark, "op9_sharding")
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for d, t, _ in documents:
        b = (t or "").encode()
        assert (rows[d]["size"], rows[d]["text_crc32"], rows[d]["law"]) == (len(b) + 16, zlib.crc32(b), "bytes")
        sizes[rows[d]["shard"]] += rows[d]["size"]
        slots[rows[d]["shard"]].append(rows[d]["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    even, largest = sum(sizes.values()) / 40, max(r["size"] for r in rows.values())
    assert all(abs(sizes[k] - even) <= largest for k in range(40))
    assert rows == run(spark, "op9_sharding")


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    kept = p.quality_rules(spark, docs, SF).cache()
    verdict = {r["doc_id"] for r in queries.op10_quality_rules(spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict
    unique = p.near_duplicates(spark, kept, SF).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert {r["doc_id"] for r in unique.collect()} == {d for d, (_, c) in want.items() if c == d}
    clean = p.decontaminate(spark, unique, SF).cache()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for r in unique.collect():
        if any(i in r["text"] for i in items):
            assert r["doc_id"] not in left
        elif r["doc_id"] not in left:
            assert any(i[k : k + 60].lower() in r["text"].lower() for i in items for k in range(len(i) - 59))
    mixed = p.mix_sources(spark, clean, SF).cache()
    assert [x.columns for x in (kept, unique, clean, mixed)] == [columns] * 4
    assert mixed.join(clean, columns, "left_anti").count() == 0
    last = p.shard(spark, mixed, SF)
    assert last.count() == mixed.count()
    whole = p.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, last.select("doc_id", "shard", "slot").collect()))
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]


def test_native_plans_have_no_python(spark):
    for name in ("op8_chat_format", "op9_sharding", "op10_quality_rules"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(queries.__file__).resolve().parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
