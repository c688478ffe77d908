"""Token counts under a unigram vocabulary, with prefixes shared in a trie.

A text's pre-tokens are its words with the vocabulary's word mark before them. The distinct new pre-tokens of a batch form a trie,
walked depth first in sorted order: a node holds the best forward log-probability of its prefix and the number of pieces on
that path, and is computed once however many pre-tokens share it. What is stored are the counts at terminals, so a document
costs one look-up for each word. Documents are read in place; nothing is exchanged.

The vocabulary is a sentencepiece model file, never trained here; the file says which kind it is. A unigram model carries log-probabilities; the
scores of other kinds are merge ranks, which stand for Zipf probabilities 1 / (rank + 1), so the counts are those of a unigram model over the
same pieces and come near, not equal, to the file's own tokenizer (``own_counts`` gives its). A character no piece covers costs one byte
piece for each of its bytes. Equal scores go to fewer pieces.

Defined cases: null or empty texts have 0 tokens; repeated rows give a row each; very long texts are read whole and very long words are one
path; ties of scores go to fewer pieces; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from arborweft.llm.common import bound_arrow, text_bytes

MARK = "▁"
COUNTS = "doc_id long, n_pretokens long, n_tokens long"


#: Fixed values of the model format: where the kind stands in the file, and the kind with log-probabilities.
TRAINER, KIND, UNIGRAM = 2, 3, 1


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message: integers, or bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def is_unigram(model: bytes) -> bool:
    """What the file itself says; a model that says nothing is of the format's default kind."""
    for number, value in _fields(model):
        if number == TRAINER:
            return dict(x for x in _fields(value) if x[0] == KIND).get(KIND, UNIGRAM) == UNIGRAM
    return True


def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """The pieces of a model with their log-probabilities, and that of a byte piece."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in plain]
    if not is_unigram(raw):  # merge ranks
        total = math.log(sum(1 / (1 - s) for s in scores))
        scores = [-math.log(1 - s) - total for s in scores]
    worst = min(scores)
    return {model.id_to_piece(i): s for i, s in zip(plain, scores, strict=True)}, worst - 10.0


class TrieCounter:
    """Piece counts of pre-tokens; terminals are kept while they are few."""

    def __init__(self, pieces: dict[str, float], byte: float, keep: int = 500_000) -> None:
        self.pieces, self.byte, self.keep = pieces, byte, keep
        self.longest = max(map(len, pieces), default=1)
        self.ends = {p[-1]: 0 for p in pieces}
        for p in pieces:
            self.ends[p[-1]] = max(self.ends[p[-1]], len(p))
        self.counts: dict[bytes, int] = {}
        self.nodes = 0

    def add(self, words: set[bytes]) -> None:
        """Count new pre-tokens: sorted, so that each node of their trie is met once."""
        pieces, ends = self.pieces, self.ends
        path, score, count = "", [0.0], [0]  # of the prefixes of the last pre-token
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            same, most = 0, min(len(path), len(text))
            while same < most and path[same] == text[same]:
                same += 1
            del score[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                c = text[end - 1]
                size = len(c.encode("utf-8", "replace"))
                best, n = score[end - 1] + size * self.byte, count[end - 1] + size
                for begin in range(max(0, end - ends.get(c, 0)), end):
                    p = pieces.get(text[begin:end])
                    if p is not None:
                        s, k = score[begin] + p, count[begin] + 1
                        if s > best or (s == best and k < n):
                            best, n = s, k
                score.append(best)
                count.append(n)
            self.nodes += len(text) - same
            path = text
            self.counts[word] = count[-1]

    def of(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text."""
    bound_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))  # as large as the vocabulary

    def run(batches):
        trie = TrieCounter(*shared.value)
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            view = memoryview(data)
            words, tokens = [], []
            for first in range(0, b.num_rows, 128):
                part = [bytes(view[offsets[i] : offsets[i + 1]]).split() for i in range(first, min(b.num_rows, first + 128))]
                new = set().union(*part)
                if len(trie.counts) > trie.keep:
                    trie.counts.clear()
                trie.add(new.difference(trie.counts))
                words += map(len, part)
                tokens += map(trie.of, part)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def own_counts(texts: list[str], model_path: str) -> list[int]:
    """Tokens of each text, word by word, by the file's own tokenizer: what the counts can be held against."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [sum(map(len, model.encode([w.decode("utf-8", "replace") for w in t.encode().split()]))) for t in texts]
