"""Odd inputs, general interfaces and the parts of the operators."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborweft.llm import chat, decontam, jaccard, lines, mixing, quality, sharding, suffix, tokens, warc
from arborweft.llm.common import Powers, join_sized, materialise, scratch_path, scratch_tables
from arborweft.llm.queries import MODEL
from tests.llm import odd
from tests.llm.test_queries import brute_components, count_words


@pytest.fixture(scope="module")
def docs(spark):
    return odd.docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return odd.docs(spark, []).cache()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert jaccard.jaccard_components(empty, bits=12).count() == 0
    assert jaccard.near_dedup(empty, bits=12).count() == 0
    assert tokens.token_counts(empty, MODEL).count() == 0
    assert lines.line_digests(empty, lines.keep_bitmaps(empty)).count() == 0
    assert sharding.shard(empty).count() == 0
    assert quality.apply_rules(empty).count() == 0
    assert quality.keep_good(empty).columns == empty.columns
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.parse(chat.render(chat.fold(chat.to_events(talk))))).count() == 0
    assert warc.parse_arc(warc.pages_to_arc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_leaks_on_odd_rows(spark, docs):
    random.seed(3)
    edited = odd.PASSAGE.upper().replace("FORTY-ONE", "forty two").replace(" THEN", "  then\n")
    more = docs.unionByName(spark.createDataFrame([(20, f"{odd.LONG} {edited}", "z"), (21, odd.PASSAGE[:40], "z")], "doc_id long, text string, source string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(1, odd.PASSAGE), (2, None), (3, ""), (4, "tiny"), (None, odd.PASSAGE)], "item_id long, text string")
    found = decontam.find_leaks(more, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(12, 1), (20, 1)}
    exact = next(r for r in found.collect() if r["doc_id"] == 12)
    assert (exact["start_byte"], exact["edits"]) == (0, 0)
    left = decontam.decontaminate(more, bench)
    assert left.columns == more.columns
    assert left.count() == more.count() - 2
    in_blocks = decontam.find_leaks(more, bench, block_bytes=50)
    assert rows(in_blocks, "doc_id", "item_id") == [(12, 1), (20, 1)]


def test_band_alignment_counts_edits():
    random.seed(5)
    item = "".join(random.choice("abcdefgh ") for _ in range(120)).strip()
    index = decontam.build_index([(7, item)], 0.09)
    b = index.text[0]
    for edits in (0, 1, 4, 8):
        text = bytearray(b.tobytes())
        for at in random.sample(range(0, len(text) - 1, 9), edits):
            text[at] = ord("z")
        found = decontam._scan(index, pa.array([f"qqq {text.decode()} rrr"]), 1 << 20)
        assert found[(0, 7)][0] <= edits
    noise = "".join(random.choice("abcdefgh ") for _ in range(3000))
    assert not decontam._scan(index, pa.array([noise]), 1 << 20)


def test_sainte_lague():
    random.seed(1)
    for _ in range(40):
        votes = [random.choice([0, random.random() * 100]) for _ in range(random.randrange(1, 8))]
        seats = random.randrange(0, 60)
        plain = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * plain[k] + 1), -k))
            plain[i] += 1
        assert mixing.sainte_lague(votes, seats) == plain
    assert mixing.share_targets([10, 1000], [5, 2], 3) == [30.0, 980.0]
    assert mixing.share_targets([0, 0], [5, 2], 3) == [0.0, 0.0]


def test_mix_on_odd_rows(spark, docs):
    got = mixing.mix(docs, block_words=8, rows_per_shard=5).collect()
    assert len(got) == docs.count()
    sizes = collections.Counter(count_words(t) for _, t, _ in odd.DOCS)
    assert collections.Counter(r["size"] for r in got) == sizes
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.join(docs.select("text").distinct(), "text", "left_anti").count() == 0


def test_suffix_array_is_sorted():
    random.seed(0)
    powers = Powers()
    for _ in range(150):
        n, letters = random.randrange(1, 90), random.choice([1, 2, 3, 20])
        t = np.array([random.randrange(1, letters + 1) for _ in range(n)] + [0], np.int16)
        assert suffix.suffix_array(t, powers).tolist() == sorted(range(n + 1), key=lambda i, b=t.tolist(): b[i:])


def test_recursion_and_common_prefixes():
    """Strings whose names need recursion over many symbols, up to long runs and repeats of repeats."""
    rng, powers = random.Random(6), Powers()
    part = [rng.randrange(1, 250) for _ in range(500)]
    mixed = [rng.randrange(1, 9) for _ in range(2000)]
    for body in (part * 3, part + [7] * 300 + part, [5] * 600, [1, 2] * 400, mixed, [rng.randrange(1, 5000) for _ in range(1200)] * 2, list(range(900, 0, -1)) * 2):
        t = np.array([*body, 0], np.int64)
        got = suffix.suffix_array(t, powers)
        plain = t.tolist()
        want = sorted(range(len(plain)), key=lambda i, b=plain: b[i:])
        assert got.tolist() == want
        if max(body) < 512:
            same, phi = suffix.common_prefixes(t.astype(np.int16), got)
            for a, b in zip(want, want[1:], strict=False):
                k = 0
                while plain[a + k] == plain[b + k]:
                    k += 1
                assert (same[b], phi[b]) == (k, a)


def test_rows_of_equal_id_and_colliding_hashes_stand_alone(spark):
    """Rows without doc_id are told apart by 128 bits, so what repeats in one stays out of the other."""
    rng = random.Random(8)
    own = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(10**6)) for _ in range(60))
    rows_ = [(None, own(), "s") for _ in range(40)]
    rows_ += [(None, rows_[0][1] + own(), "s"), (3, own(), "s"), (3, own(), "s")]
    found = suffix.remove_repeats(odd.docs(spark, rows_), 200)
    gone = {r["n_bytes"]: r["n_removed"] for r in found.collect()}
    assert sorted(v for v in gone.values() if v) == [len(rows_[0][1])] * (2 if len(rows_[0][1]) in gone else 1)
    assert found.count() == len(rows_)
    assert suffix._rows(odd.docs(spark, rows_)).select("_id", "_tag").distinct().count() == len(rows_)


@pytest.mark.parametrize("options", [{}, {"wide_bytes": 1200, "shard_bytes": 2000}])
def test_repeats_on_odd_rows(docs, options):
    n = 60
    data = [((d, t), (t or "").encode()) for d, t, _ in odd.DOCS]
    seen = collections.Counter(hash(b[i : i + n]) for _, b in data for i in range(len(b) - n + 1))
    want = []
    for (d, _), b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[hash(b[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert rows(suffix.remove_repeats(docs, n, **options), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize(("n", "percent", "options"), [(3, 90, {}), (2, 70, {"chunk_shingles": 80, "hot": 1}), (5, 80, {"hot": 0})])
def test_components_on_odd_rows(docs, n, percent, options):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, n, percent, bits=12, **options).collect()}
    keyed = {-1 if d is None else d: t for d, t, _ in odd.DOCS}
    want = brute_components(list(keyed.items()), n, percent)
    assert {(d, s, c) for d, s, c in got if d is not None} == {(d, s, c) for d, (s, c) in want.items() if d != -1}
    assert any(d is None for d, _, _ in got)


def test_rows_of_one_id_are_one_node(spark):
    made = [(1, odd.NEAR, "a"), (2, "q w e r t y", "a"), (1, "q w e r t y", "a"), (3, odd.NEAR, "a"), (4, "solo text here now", "a")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(odd.docs(spark, made), bits=12).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_chains_and_clusters_equal_brute_force(spark):
    random.seed(11)
    words = [f"v{i}" for i in range(4000)]
    made, k = [], 0
    for _ in range(25):  # texts that drift step by step, so links form chains, besides wide groups
        text = random.sample(words, random.choice([30, 60, 200]))
        for _ in range(random.choice([2, 12, 40])):
            text = list(text)
            for _ in range(random.choice([0, 1, 2])):
                text[random.randrange(len(text))] = random.choice(words)
            made.append((k, " ".join(text), "s"))
            k += 1
    random.shuffle(made)
    for options in ({}, {"chunk_shingles": 500, "hot": 5}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd.docs(spark, made), 1, 90, bits=12, **options).collect()}
        assert got == brute_components([x[:2] for x in made], 1, 90)


def test_low_similarities_are_refused(empty):
    with pytest.raises(ValueError, match="67"):
        jaccard.jaccard_components(empty, percent=60)


def test_divide_skip_finds_all():
    random.seed(4)
    index, sets = jaccard.Inverted(), []
    for _ in range(120):
        base = sets[-1] if sets and random.random() < 0.6 else random.sample(range(300), 40)
        s = sorted(set(base) - {random.choice(list(base))} | {random.randrange(300)})
        sets.append(s)
        index.add(np.array(s, np.uint64))
    for percent in (90, 60, 30):
        for s in sets[:40]:
            want = [(k, len(set(s) & set(o))) for k, o in enumerate(sets) if 100 * len(set(s) & set(o)) >= percent * len(set(s) | set(o))]
            assert sorted(index.search(np.array(s, np.uint64), percent)) == want
            odd_ones = sorted(index.search(np.array(s, np.uint64), percent, lambda k: k % 2))
            assert odd_ones == [x for x in want if x[0] % 2]


def test_near_dedup_keeps_one(docs):
    kept = jaccard.near_dedup(docs, 5, 80, bits=12)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=repr) == sorted([1, 2, 3, 4, 5, 7, 10, None, 11, 12, 13, 14], key=repr)


def test_rows_without_id_are_nodes_of_their_own(spark):
    made = [(6, odd.NEAR, "a"), (None, odd.NEAR, "a"), (5, odd.NEAR, "a"), (None, "lone row of some words", "a"), (None, "lone row of some words", "b")]
    made += [(None, "other words that stand alone", "a"), (None, "", "a"), (None, None, "b"), ((1 << 63) - 1, "an id at the end", "a"), (-(1 << 63), "an id at the start", "a")]
    made += [(7, odd.PASSAGE * 9 + " x1 x2 x3", "a"), (None, odd.PASSAGE * 9 + " y", "a")]
    table = odd.docs(spark, made)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(table, bits=12, percent=80).collect())
    assert got == collections.Counter(
        {(6, 5): 1, (5, 5): 1, (None, 5): 1, (None, None): 5, ((1 << 63) - 1,) * 2: 1, (-(1 << 63),) * 2: 1, (7, 7): 1, (None, 7): 1}
    )
    kept = jaccard.near_dedup(table, 3, 80, bits=12)
    assert kept.columns == table.columns
    left = collections.Counter((r["doc_id"], (r["text"] or "")[:8]) for r in kept.collect())
    assert left == collections.Counter(
        {(5, odd.NEAR[:8]): 1, (None, "lone row"): 1, (None, "other wo"): 1, (None, ""): 2, ((1 << 63) - 1, "an id at"): 1, (-(1 << 63), "an id at"): 1, (7, odd.PASSAGE[:8]): 1}
    )


def test_sketch_counts_beyond_the_mean(spark):
    """A sketch that everything shares still tells frequent n-grams from rare ones."""
    rows = [(i, f"common words here u{i} v{i} w{i} x{i} y{i}", "s") for i in range(600)]
    table = jaccard._sketch(odd.docs(spark, rows, clash=False), 3, 6)
    hot = next(jaccard._sets(pa.array(["common words here"]), 3, Powers()))
    assert table[int(hot[0] >> np.uint64(58))] > 300
    assert np.median(table) < 60
    small = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(odd.docs(spark, rows[:60]), 3, 90, bits=6, hot=0).collect()}
    assert small == {(i, i) for i in range(60)}
    assert [jaccard.sketch_bits(n) for n in (0, 10**9, 10**11, 10**14)] == [22, 22, 26, 26]


def test_token_counts_on_odd_rows(docs):
    got = rows(tokens.token_counts(docs, MODEL), "doc_id", "n_pretokens")
    assert got == sorted(((d, count_words(t)) for d, t, _ in odd.DOCS), key=repr)
    trie = tokens.TrieCounter({"▁": -1.0, "a": -2.0, "▁a": -1.5, "ab": -2.0, "b": -3.0}, -9.0)
    trie.add({b"ab", b"aa", b"abb", "é".encode()})
    assert trie.counts == {b"ab": 2, b"aa": 2, b"abb": 3, "é".encode(): 3}
    assert trie.nodes == 6  # the mark and 'a' are shared


def test_lines_on_odd_rows(spark, docs):
    for keep in ("first", "none"):
        clashing = docs.withColumns({c: F.col("source") for c in ("_row", "_doc", "_hash", "bitmap", "_pos", "_n_lines", "_document")})
        maps = lines.keep_bitmaps(clashing, min_docs=2, min_chars=1, keep=keep)
        left = lines.apply_bitmaps(clashing, maps)
        assert left.columns == [*clashing.columns, "__n_lines", "_n_dropped"]
        assert left.where("NOT _row <=> source OR NOT bitmap <=> source").count() == 0
        texts = {r["doc_id"]: r["text"] for r in left.where("doc_id != 9").collect()}
        assert texts[1] == "Hello World\nhello world \n\n x"  # one document alone
        assert texts[7] == ("one two" if keep == "first" else "")
        assert texts[2] == texts[3] == ""
        nine = [r["text"] for r in left.where("doc_id = 9").collect()]
        assert nine == ["", ""]
    bits = lines._pack([0, 9], 12)
    assert lines.unpack(bits, 12).tolist() == [i not in (0, 9) for i in range(12)]
    assert lines.unpack(None, 2).all()


def test_arc_versions_round_trip(spark, tmp_path):
    made = [(1, "http://a.b/c d", "<p>é</p>"), (2, None, None), (3, "http://x", "<p>é</p>"), (4, "http://y", ""), (4, "http://y", ""), (None, "http://z", "line\r\n\r\nWARC/1.1\r\n"), (5, "http://w", "x" * 200_000)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("status", F.lit("clash"))
    arcs = warc.pages_to_arc(pages)
    versions = {r["content"].split(b"\n")[1][:1] for r in arcs.collect()}
    assert versions == {b"1", b"2"}
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.mark_revisits(warc.parse_arc(arcs)), path, file_bytes=300)
    read = warc.read_warc(spark, path).cache()
    got = {(r["page_id"], r["record_type"], r["payload_bytes"], r["refers"]) for r in read.withColumn("refers", warc.page_number(F.col("refers_to_id"))).collect()}
    assert read.count() == len(made)
    assert read.where("error IS NOT NULL").count() == 0
    assert (1, "revisit", 9, 3) in got
    assert (3, "response", 9, None) in got
    assert (2, "revisit", 0, 4) in got
    assert (None, "response", 18, None) in got
    assert (5, "response", 200_000, None) in got
    assert bytes(read.where("page_id = 3").first()["payload"]) == "<p>é</p>".encode()
    assert read.where("page_id = 1").first()["url"] == "http://a.b/c%20d"
    short = warc.mark_revisits(warc.parse_arc(arcs), min_bytes=10)
    assert short.where("record_type = 'revisit'").count() == 0


def arc(records, version="1"):
    block = f"{version} 0 own\n{warc.ARC_FIELDS.get(version, 'URL')}\n\n".encode()
    out = b"filedesc://x 0.0.0.0 20020101000000 text/plain %d\n" % len(block) + block
    for head, content, size in records:
        out += head.encode("latin-1") + b" %d\n" % (len(content) if size is None else size) + content + b"\n"
    return out


def test_archives_as_they_are_found(spark, tmp_path):
    """Payloads that are not UTF-8, images, blanks in addresses, short dates, other protocols, cut-off and broken containers."""
    image = bytes(range(256)) * 40
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n"
    whole = arc(
        [
            ("http://a/x y z 1.2.3.4 20020304050607 text/html", http + "caf\xe9".encode("latin-1"), None),
            ("http://a/i 1.2.3.4 20020304 image/png", http + image, None),
            ("dns:a.b 1.2.3.4 200203040506 text/dns", b"20020304\na.b 1.2.3.4", None),
            ("http://a/j 1.2.3.4 20020304 image/png", http + image, None),
            ("http://a/bad 1.2.3.4 yesterday text/html", http, None),
            ("http://a/cut 1.2.3.4 20020304050607 text/html", http + b"begin", 5000),
        ]
    )
    broken = arc([("http://a/ok 1.2.3.4 20020304050607 text/html", http, None)]) + b"no header here\nrest"
    archives = spark.createDataFrame([(bytearray(x),) for x in (whole, broken, b"junk", arc([], "9"), b"")], "content binary")
    found = warc.parse_arc(archives).cache()
    rows_ = {r["url"]: r for r in found.collect() if r["url"]}
    assert bytes(rows_["http://a/x y z"]["payload"]) == b"caf\xe9"
    assert (rows_["http://a/x y z"]["status"], rows_["http://a/x y z"]["date"]) == (404, "2002-03-04T05:06:07Z")
    assert (rows_["dns:a.b"]["kind"], rows_["dns:a.b"]["date"]) == ("resource", "2002-03-04T05:06:00Z")
    errors = sorted(r["error"] for r in found.where("error IS NOT NULL").collect())
    assert [e.split(":")[0] for e in errors[:1]] == ["date"]
    assert [e for e in errors if e.startswith("truncated")] == [f"truncated: {len(http) + 5 + 1} of 5000 bytes"]
    assert sum(e.startswith("version block") for e in errors) == 3
    assert sum(e.startswith("record header") for e in errors) == 1
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.mark_revisits(found), path)
    read = warc.read_warc(spark, path).cache()
    assert collections.Counter(r["record_type"] for r in read.collect()) == collections.Counter({"response": 3, "resource": 1, "revisit": 1})
    assert {bytes(r["payload"]) for r in read.where("record_type != 'revisit'").collect()} == {b"caf\xe9", image, b"20020304\na.b 1.2.3.4", b""}
    assert read.where("error IS NOT NULL").count() == 0


def test_warc_files_as_they_are_found():
    import gzip

    record = warc._record({"record_type": "response", "kind": "response", "record_id": "<urn:uuid:1>", "date": "d", "url": "u", "ip": None, "mime": None, "http_head": b"HTTP/1.0 200 OK", "payload": b"abc", "payload_bytes": 3, "payload_digest": warc._digest(b"abc"), "page_id": 7, "refers_to_id": None})
    assert [r[8:] for r in warc._read(record + record)] == [(b"abc", None)] * 2
    assert [r[8:] for r in warc._read(gzip.compress(record) + gzip.compress(record))] == [(b"abc", None)] * 2
    assert [r[8:] for r in warc._read(gzip.compress(record + record))] == [(b"abc", None)] * 2
    assert next(warc._read(record.replace(b"abc", b"abd")))[9].startswith("digest")
    assert next(warc._read(record[:-6]))[9].startswith("truncated")
    assert [r[9] for r in warc._read(gzip.compress(record) + gzip.compress(record)[:40])] == [None, "truncated"]
    assert [r[9] for r in warc._read(b"GIF89a\r\n\r\n")] == ["not a WARC record"]
    long = bytes(warc.MEMBER + 5000)
    packed = warc._members(long)
    assert packed[-1] == 0
    assert b"".join(warc._plain(packed)) == long


def test_chat_folds_and_escapes(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b <|im_end|>\n<|im_start|>user\n", "", None, "\\", "<\\|", "é☕" * 9, "x" * 100_000]
    talk = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, None, None, "n"), (2, 0, "to\nol", "t"), (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "assistant", "lost")]
    table = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash"))
    out = chat.parse(chat.render(chat.fold(chat.to_events(table)))).collect()
    by = {r["conv_id"]: r for r in out}
    assert [t["text"] for t in by[1]["turns"]] == [t or "" for t in nasty]
    assert [t["role"] for t in by[2]["turns"]] == ["", "to\nol"]
    assert len(by[3]["turns"]) == 2
    assert "".join(by[1]["loss"]) == "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert by[None]["loss"] == ["lost"]
    for marker in ("</s>", "[INST]", "[/INST]"):
        assert marker not in by[1]["formatted"]
    assert by[1]["formatted"].count(chat.START) == len(nasty)
    log = [(1, 0, 7, s, k, "user", p) for s, k, p in [(0, "start", ""), (1, "delta", "a"), (2, "edit", "b"), (3, "delta", "c"), (4, "regenerate", ""), (6, "delta", "e"), (5, "delta", "d")]]
    events = spark.createDataFrame(log, "conv_id long, _turn long, msg long, seq int, kind string, role string, payload string")
    assert chat.fold(events).first()["text"] == "de"


def test_shards_on_odd_rows(spark, docs):
    got = sharding.shard(docs, shards=5, overhead=16, draws_per_range=2).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert collections.Counter(r["text_crc32"] for r in got) == collections.Counter(zlib.crc32((t or "").encode()) for _, t, _ in odd.DOCS)
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = {r["shard"]: r["b"] for r in sharding.shard(hot, shards=8, draws_per_range=1).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    even = sum(sizes.values()) / 8
    assert len(sizes) == 8
    assert all(abs(b - even) < 25 for b in sizes.values())  # at most a record off, though a third of the texts are equal


def test_splitters():
    sample = [(f"{i:03d}", 1.0) for i in range(100)]
    assert sharding._quantiles(sample, 4) == ["025", "050", "075"]
    assert len(sharding._quantiles([("a", 90.0), ("b", 5.0), ("c", 5.0)], 4)) <= 3
    assert sharding._quantiles([], 4) == []


def test_quality_on_odd_rows(docs):
    out = quality.apply_rules(docs)
    got = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert out.count() == docs.count()
    assert (got[2]["n_words"], got[2]["word_chars"], got[2]["kept"]) == (0, 0, False)
    assert got[4]["n_words"] == 0
    assert got[1]["n_dup_lines"] == 0
    assert got[13]["n_repeat_words"] == 400
    assert got[13]["failed_rule"] == "base"
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 14").count() == 1


def test_repeat_words_equal_brute_force(spark):
    random.seed(9)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 400, 3000)] + [" ".join(f"u{random.randrange(60)}" for _ in range(2000))]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_stats(odd.docs(spark, [(i, t, "s") for i, t in enumerate(texts)], clash=False)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i] == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_cascade_order_is_by_rejection_per_cost(spark):
    never, dear, cheap = (quality.Rule(n, lambda d: F.lit(True)) for n in ("never", "dear", "cheap"))
    cost = {"never": 1, "dear": 50, "cheap": 1}
    assert [r.name for r in quality.order_rules([never, dear, cheap], {0: 10, 6: 30}, cost)] == ["cheap", "never", "dear"]
    assert [r.name for r in quality.order_rules([never, dear, cheap], {0: 10, 2: 900, 4: 1}, cost)][0] == "dear"
    made = [(i, " ".join([("#$%" * 9 if i % 2 else "plain"), *(f"word{i}x{k}" for k in range(60))]), "s") for i in range(40)]
    docs = odd.docs(spark, made, clash=False)
    slow = quality.Rule("slow", lambda d: d.n_repeat_words + F.length(F.repeat(d.text, 2000)) < 0)
    order = [r.name for r in quality.cascade_order(docs, [slow, *quality.default_rules()])]
    assert order[0] == "symbols"
    assert set(order) == {"slow", *(r.name for r in quality.default_rules())}
    assert quality.cascade_order(docs, []) == []
    assert quality.measure(docs, quality.base_rules()).keys() == {"few_words", "repeats"}


def test_lazy_and_whole_verdicts_agree(spark, docs):
    made = [(i, t, "s") for i, t in enumerate(["- a b c d e f\n" * 12, "WORD " * 20 + "low " * 50, " ".join(f"w{k}..." for k in range(70)), "\n".join(f"line {k} of some text..." for k in range(30)), " ".join(str(k) for k in range(99)), "x\n" * 80, " ".join("q" * 20 + str(k) for k in range(60))])]
    table = docs.unionByName(odd.docs(spark, made))
    kept = quality.apply_rules(table, keep=["doc_id", "n_words", "kept"])
    assert kept.columns[:3] == ["doc_id", "n_words_given", "kept_given"]
    want = collections.Counter(r["doc_id"] for r in kept.where("kept").collect())
    assert collections.Counter(r["doc_id"] for r in quality.keep_good(table).collect()) == want


def test_bars_of_tables_are_layout(spark):
    word = lambda k: f"{'bcdfghklmn'[k % 10]}a{'prstvwz'[k % 7]}e{'io'[k % 2]}n{chr(97 + k % 25)}"
    cells = [word(k) for k in range(90)]
    table = "\n".join(" | ".join(cells[k : k + 5]) for k in range(0, 90, 5))
    made = [table, table.replace("|", "#"), " ".join(f"{c}|||" for c in cells), "\n".join(f"| {k} | {k * 7} | {k * 11} |" for k in range(40)), "| " * 99]
    made.append(" | ".join(f"{chr(97 + k % 26)}{k // 26}" for k in range(90)) + " " + table)
    got = quality.apply_rules(odd.docs(spark, [(i, t, "s") for i, t in enumerate(made)], clash=False)).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert {r["doc_id"]: r["n_symbols"] for r in got}[0] == table.count("|")
    kept = quality.keep_good(odd.docs(spark, [(i, t, "s") for i, t in enumerate(made)], clash=False))
    assert {r["doc_id"] for r in kept.collect()} == {0, 5}


def test_sized_join_has_another_way(spark):
    small = materialise(spark.range(50).withColumnRenamed("id", "k"), "small")
    big = spark.range(100).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in join_sized(big, small, "k", "inner", most=1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert join_sized(big, small, "k", "inner", most=0).count() == 50


def test_scratch_tables_go_with_their_block(spark):
    with scratch_tables(spark):
        path = scratch_path(spark, "short")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
