from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", "a b", "\t\x0b\x0c\r\n", "é", "漢字", "😀 x", "a b", "a b", "\x00\x01\x02", "▁", "▁▁ a", "<|endoftext|>", "x" * 300, "word. " * 40, "same line\n" * 12, " lead", "trail ", "two  spaces", "a\n\nb", "a\n\n\nb\n\n"]


def words(text):
    return WORD.findall(text or "")


def noise(seed, n, vocabulary=60, longest=80):
    """Texts of random words, with copies, edited copies, shared passages, odd ones, nulls and a long one."""
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: "".join(r.choice(known) + r.choice([" ", " ", " ", ". ", "\n", ", ", "  "]) for _ in range(k))
    passage = text(30)
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            out.append(r.choice(out))
        elif kind < 0.3 and out:
            w = (r.choice(out) or "").split(" ")
            w[r.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        elif kind < 0.4:
            out.append(text(r.randint(0, 20)) + passage + text(r.randint(0, 20)))
        elif kind < 0.45:
            out.append(None)
        else:
            out.append(text(r.randint(0, longest)))
    return [*out, *ODD, text(4000)]


def documents(spark, texts, first=0):
    rows = [(first + i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def saved(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
