"""Small tables with everything that goes wrong in large ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, block long, _k long, `key` string, `set` string, n int, payload binary, held_out string, digit long, leaf long, entry_id long, row string"


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def texts(seed=3):
    r = random.Random(seed)
    base = [words(r, 90) for _ in range(12)]
    near = [" ".join(w if i not in (k, k + 40) else "changed" for i, w in enumerate(base[0].split())) for k in range(6)]
    passage = words(r, 70, "klmnop")
    shared = [words(r, 20) + " " + passage + " " + words(r, 25) for _ in range(5)]
    longer = words(r, 30_000)
    odd = ["", None, " ", "\n\t", "a", "Été à la plage\nÉté à la plage", "日本語 テキスト 🙂 " * 30, "x" * 5000, base[1].upper(), base[1], base[1], "K" + base[2], "\x1c  \x85 \xa0 a", "one two three four", "one two three four"]
    return base + near + shared + [longer, longer[:60_000]] + odd


def docs(spark, rows=None, langs=("en", "fr", None)):
    rows = texts() if rows is None else rows
    made = [(i, t, langs[i % len(langs)], None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) + (i,) * 3 + ("k", None, 1, b"x", "h", 5, None, 7, "r") for i, t in enumerate(rows)]
    made += [made[3], made[3]]  # repeated rows
    made += [(None, rows[0] if rows else "z", None, None, None) + (None,) * 12, (None, None, None, None, None) + (None,) * 12]
    return spark.createDataFrame(made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
