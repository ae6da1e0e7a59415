import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from vidra.llm.bpe import Codec, Digest, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap,threads", [(7, 3, 1), (16, 4, 1), (50, 8, 2), (1 << 16, 512, 1)])
def test_chunks_of_any_size_encode_as_one_text(reference, chunk, overlap, threads):
    own = Codec(PATH, public_tokenizers.PATTERN, chunk, overlap, threads)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "Z", " ", "  ", "\n", "\t\n ", "12", "'ll", "'s", "!", "😀", "ab" * 9, " " * 20, "x" * 70, "<|endoftext|>"]) for _ in range(rng.randrange(120)))
        want = reference.encode_ordinary(text)
        assert own.encode(text) == want
        digest = Digest(own)
        for i in range(0, len(want), 3):
            digest.add(want[i : i + 3])
        assert digest.row() == digests(want, text)


def digests(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_chunks_dealt_over_tasks(spark, reference):
    """Most texts take several chunks; some have pre-tokens that span an overlap, or whole chunks."""
    rng = random.Random(15)
    bits = ["a", "é", "Z", " ", "  ", "\n", "\t\n ", "12", "'ll", "'s", "!", "😀", "ab" * 9, " " * 20, "x" * 70, "<|endoftext|>", " word", " other"]
    texts = ["".join(rng.choice(bits[:-3] if i % 4 else bits) for _ in range(rng.randrange(120))) for i in range(300)] + [" word" * 3000, "x" * 9000, "", None, "a b " * 10]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    want = sorted((*digests(ids := reference.encode_ordinary(t or ""), t or ""), ids) for t in [*texts, texts[7]])
    for chunk, overlap in ((16, 8), (40, 30), (500, 100)):
        got = encode(spark, docs, PATH, public_tokenizers.PATTERN, True, chunk, overlap).collect()
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.token_ids)) for r in got) == want
        assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in docs.collect())


def test_table_with_nulls_repeats_and_other_columns(spark, reference):
    long = "Ab c\n" * 40_000
    rows = [(1, None, "x"), (2, "", None), (3, "Hello  world's\n\n end", "y"), (3, "Hello  world's\n\n end", "y"), (None, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    tokens = encode(spark, docs, PATH, public_tokenizers.PATTERN)
    got = sorted((r.doc_id or 0, r.n_tokens, list(r.token_ids)) for r in tokens.collect())
    want = sorted((d or 0, len(t := reference.encode_ordinary(x or "")), t) for d, x, _ in rows)
    assert got == want
    back = sorted((r.doc_id or 0, bytes(r.raw).decode()) for r in decode(spark, tokens, PATH, public_tokenizers.PATTERN).collect())
    assert back == sorted((d or 0, x or "") for d, x, _ in rows)
    assert encode(spark, docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
