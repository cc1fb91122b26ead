from __future__ import annotations

import random

import pytest

CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, n_hit int, _row string, _text string, _id int, _block int, shard string, slot string, quality string, contamination string, size string, target string, taken string, `odd name` string, _hash string"


def _rows():
    rng = random.Random(7)
    vocabulary = [a + b for a in ("ta", "ri", "Mo", "zü", "ke", "la", "日") for b in ("n", "st", "el", "ß", "o", "ing", "本")]
    word = lambda: rng.choice(vocabulary)
    passage = " ".join(word() for _ in range(60))
    line = "  A common Line of forty characters and more, indeed  "
    texts = [None, "", " ", "\n", "one", "\n\n  \n", "one two three four", passage, passage, passage.replace(" ", "\n", 3), line, "x\n" * 30]
    for k in range(40):
        body = " ".join(word() for _ in range(rng.randrange(5, 120)))
        if k % 4 == 0:
            body += " " + passage
        if k % 5 == 0:
            body += "\n" + line + "\n" + line.upper()
        texts.append(body)
    near = [word() for _ in range(200)]
    for k in range(6):
        changed = list(near)
        changed[30 * k + 3] = f"changed{k}"
        texts.append(" ".join(changed))
    texts += ["long " + " ".join(word() for _ in range(40_000)), "a" * 3000, "ab" * 700, texts[15], texts[15]]
    rows = []
    for k, text in enumerate(texts):
        source = None if k % 11 == 3 else f"s{k % 4}"
        rows.append((k, text, None if k % 13 == 5 else ("en" if k % 3 else "de"), source))
    rows += [(5, "the same id again with some other words in it", "en", "s1"), rows[20], rows[20], (None, "no id but a text of some words", "en", "s0"), (None, None, None, None), (None, passage, "en", None)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    full = [(i, t, l, s, len(t) if t is not None else None, *["x" if kind == "string" else 1 for kind in [c.rsplit(" ", 1)[1] for c in CLASHING.split(", ")[5:]]]) for i, t, l, s in ROWS]
    return spark.createDataFrame(full, CLASHING).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
