"""Operator 7 with tokenizers of other kinds, and when hashes of units collide."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from weirline.llm import common, queries, token_files

TEXTS = ["", " ", "Some Words, and\n\nmore of  them", "it's  'll \t\tx y 　z é é", "1234 5678 <|endoftext|> x", "日本 語\n語"]


def encoded(encoder, texts):
    raw = [x.encode() for x in texts]
    ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    return [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))]


def test_other_tokenizers_encode_whole_texts(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    encoder, t = token_files.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_units and token_files.Encoder(queries.tokenizer_path()).by_units
    assert encoded(encoder, TEXTS) == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]
    to = common.new_path(spark, "test")
    token_files.write(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"), to, path)
    assert Counter((r.doc_id, *r.ids) for r in token_files.read(spark, to).collect()) == Counter((k, *t.encode(x, add_special_tokens=False).ids, 0) for k, x in enumerate(TEXTS))


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_ways_to_split(tmp_path, change):
    import json

    made = json.loads(Tokenizer.from_file(queries.tokenizer_path()).to_str())
    made["pre_tokenizer"] |= change
    path = str(tmp_path / "tokenizer.json")
    (tmp_path / "tokenizer.json").write_text(json.dumps(made))
    encoder = token_files.Encoder(path)
    assert not encoder.by_units and encoded(encoder, TEXTS) == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_units_of_one_hash(monkeypatch):
    """With a first hash of six bits units collide; the second tells them apart."""
    full = common.byte_hashes
    monkeypatch.setattr(common, "byte_hashes", lambda data, s, e, sums=None: full(data, s, e, sums) & np.uint64(63) if sums is None else full(data, s, e, sums))
    encoder = token_files.Encoder(queries.tokenizer_path())
    texts = [f"{chr(97 + k)} word{k} an{k}other" for k in range(26)]
    expected = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoded(encoder, texts) == expected
    assert [encoded(encoder, [x])[0] for x in texts] == expected
