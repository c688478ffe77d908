"""Verbatim parts of benchmark items, wherever they begin."""

import random

import numpy as np
import pyarrow as pa
import pytest

from arborweft.llm import decontam

WORDS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, size):
    text = ""
    while len(text) < size:
        text += "".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 11))) + " "
    return text[:size]


def test_every_part_of_69_bytes_is_found():
    rng = random.Random(11)
    items = [(k, prose(rng, size)) for k, size in enumerate((70, 81, 100, 128, 161, 200, 255, 394))]
    index = decontam.build_index(items, 0.09)
    texts, want = [], set()
    for number, item in items:
        for at in range(len(item) - 68):
            part = item[at : at + 69]
            if part != part.strip():
                continue
            before, after = (prose(rng, rng.randrange(200)).strip() for _ in range(2))
            texts.append(f"{before} {part} {after}" if at % 3 else f"{part} {after}" if at % 2 else f"{before} {part}")
            want.add((len(texts) - 1, number))
    assert len(want) > 500
    assert set(decontam._scan(index, pa.array(texts), 1 << 16)) == want


def test_documents_with_parts_are_reported_and_removed(spark):
    rng = random.Random(12)
    item, clean = prose(rng, 300).strip(), prose(rng, 900).strip()
    docs = spark.createDataFrame([(1, f"{clean} {item[101:201].strip()} {clean}"), (2, clean), (3, f"{clean} {item[:40]}")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()] == [(1, 9)]
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()} == {2, 3}


def fewest_edits(query, text):
    """Edits of the best alignment of the query with any part of the text, by the whole table."""
    along = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in query:
        step = np.empty_like(row)
        step[0] = row[0] + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != c))
        row = np.minimum.accumulate(step - along) + along
    return int(row.min())


@pytest.mark.parametrize("postings", [1 << 22, 200])
def test_matches_equal_brute_force(monkeypatch, postings):
    """Every document against every segment by the whole alignment table: the same pairs, with the same edits."""
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    rng = random.Random(21)
    items = [(k, prose(rng, size).strip()) for k, size in enumerate((40, 64, 90, 150, 260))]
    texts = [prose(rng, 200), "", "tiny"]
    for _, item in items:
        for edits in (0, 2, 4, 6, 9, 13, 20):
            own = list(item)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice(["", rng.choice(WORDS), own[at] + rng.choice(WORDS)])
            texts.append(f"{prose(rng, rng.randrange(60))} {''.join(own)} {prose(rng, rng.randrange(60))}")
    index = decontam.build_index(items, 0.09)
    plain = [decontam._normal(raw, np.array([0, len(raw)]))[0] if len(raw) else raw for raw in (np.frombuffer(t.encode(), np.uint8) for t in texts)]
    want = {}
    for r, text in enumerate(plain):
        for number in range(len(items)):
            own = [s for s in range(len(index.text)) if index.item[s] == number]
            for kind in ([s for s in own if s < index.parts], [s for s in own if s >= index.parts]):
                cost = [fewest_edits(index.text[s], text) for s in kind]
                within = [c for s, c in zip(kind, cost, strict=True) if c <= index.edits[s]]
                if within:
                    want[r, number] = min(within)
                    break
    got = {k: v[0] for k, v in decontam._scan(index, pa.array(texts), 1 << 10).items()}
    assert got == want
    assert 20 < len(want) < len(texts) * len(items) / 2


def test_many_short_rows_against_many_segments():
    """Rows times segments beyond 31 bits in one slice: keys stay apart."""
    rng = random.Random(22)
    items = [(k, prose(rng, 180).strip()) for k in range(700)]
    index = decontam.build_index(items, 0.09)
    texts = ["a b"] * 420_000
    assert len(texts) * len(index.text) > 1 << 31
    want = {(k, k % 700) for k in [*range(0, 420_000, 9_001), 419_999]}
    for k, item in want:
        texts[k] = items[item][1]
    assert set(decontam._scan(index, pa.array(texts), 16 << 20)) == want
