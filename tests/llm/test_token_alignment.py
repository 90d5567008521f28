"""Token alignment against plain loops over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenlens.llm import token_alignment
from screenlens.llm.packing import tokenizer_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.randoms(use_true_random=False))
def test_align_equals_plain_search(lengths, rng):
    ends_a = np.cumsum(lengths)
    last = int(ends_a[-1])
    mix = set(rng.sample(range(1, last + 1), rng.randint(1, last))) | set(ends_a[: rng.randint(0, len(ends_a))].tolist()) | {last}
    ends_b = np.array(sorted(mix))
    groups_a, groups_b, link_a, link_b = token_alignment.align(ends_a, ends_b)
    shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert ends_a[np.cumsum(groups_a) - 1].tolist() == shared
    assert ends_b[np.cumsum(groups_b) - 1].tolist() == shared
    begin_a, begin_b = [0, *ends_a[:-1].tolist()], [0, *ends_b[:-1].tolist()]
    expected = [
        (i, j)
        for i in range(len(ends_a))
        for j in range(len(ends_b))
        if begin_a[i] < ends_b[j] and begin_b[j] < ends_a[i]
    ]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == expected


def brute(rows):
    """What the contract says, byte by byte, with the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    slow.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    bytes_a = token_alignment.byte_level_tokens(tokenizer_path())
    _, bytes_b = token_alignment.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    found = []
    for doc_id, text in rows:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            found.append((doc_id, [], [], []))
            continue
        owner_a = [n for n, i in enumerate(a) for _ in bytes_a[i]]
        owner_b = [n for n, i in enumerate(b) for _ in bytes_b[i]]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, ga, gb = [], [a[0]], [b[0]]
        for at in range(1, len(whole)):
            new_a, new_b = owner_a[at] != owner_a[at - 1], owner_b[at] != owner_b[at - 1]
            if new_a and new_b:
                groups.append((ga, gb))
                ga, gb = [], []
            if new_a:
                ga.append(a[owner_a[at]])
            if new_b:
                gb.append(b[owner_b[at]])
        groups.append((ga, gb))
        found.append((doc_id, groups, [(a[i], b[j]) for i, j in links], (len(a), len(b))))
    counts = Counter(pair for _, _, links, _ in found for pair in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc_id, groups, links, sizes in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id,
                *(sizes or (0, 0)),
                len(groups),
                len(links),
                sum(counts[p] == best[p[0]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(line.encode()).hexdigest() if line else "",
            )
        )
    return out, counts


ODD = [None, "", " ", "  two  spaces ", "a▁b", "<s> </s> <unk> <|endoftext|>", "日本語 és ½ ² \U0001f600 ü", "\x00\t\r\n", "same", "same"]


@pytest.mark.parametrize("shard", [1, 60, token_alignment.SHARD])
def test_documents_equal_brute_force(spark, docs, shard):
    rng = random.Random(5)
    words = ["the", "lecture", "Étion", "unbelievably", "zzyx", "12345", "é", "\n", "—", "tokenisation"]
    texts = [*ODD, *("".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(30)), "x " * 9000 + "ä" * 3000]
    rows = [*enumerate(texts), (None, "same"), (3, "again three")]
    done, pairs = token_alignment.token_alignment(docs(rows).repartition(3), shard=shard)
    expected, counts = brute(rows)
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(map(tuple, done.collect()), key=key) == sorted(expected, key=key)
    found = {(r["a"], r["b"]): (r["count"], r["best"]) for r in pairs.collect()}
    assert {p: n for p, (n, _) in found.items()} == dict(counts)


def test_empty_table(docs):
    done, pairs = token_alignment.token_alignment(docs([]))
    assert done.count() == 0 and pairs.count() == 0


def test_sample_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    done, _ = token_alignment.token_alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(map(tuple, done.collect())) == sorted(brute(rows)[0])


def test_new_words_are_encoded_together_and_kept(monkeypatch):
    """Ids of a text are put together from those of its words, however many are kept."""
    path = tokenizer_path("piece_bpe_32k.model")
    model, tokens = token_alignment.pieces_of(path)
    rng = random.Random(7)
    words = ["the", "a\nb", "\t", "Étion", "ﬁ", "\x00", "x" * 50, "日本", "\U0001f600é", "<s>", "zzyx", "12,5", "　", "é"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "s"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for kept in (0, 5, token_alignment.WORDS_KEPT):
        monkeypatch.setattr(token_alignment, "WORDS_KEPT", kept)
        held = token_alignment.Words(model, tokens)
        assert held.apart
        for text in [*texts, *[t for t in ODD if t], "a  b", " a", "a ", "  ", "a▁b c"]:
            ids = model.encode(text)
            same = b"".join(tokens[i] for i in ids) == (" " + text).encode()
            found = held.ids(text)
            assert (found.tolist() if found is not None else None) == (ids if same else None), text
        assert len(held) <= kept and max(map(len, held), default=0) <= token_alignment.WORD_LENGTH
    calls = []
    held.model = type("Counted", (), {"encode": lambda _, text: calls.append(text) or model.encode(text)})()
    held.ids("the brandnew the zzyx brandnew")
    assert calls == ["brandnew"]
