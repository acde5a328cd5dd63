"""Small documents with the cases every operator must define."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, row string, node string"


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def documents() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, copies, repeated rows;
    the columns after n_chars have names that operators use themselves."""
    base = prose(1)
    texts = {1: base, 2: base, 3: base + " tail", 4: prose(2), 5: "", 6: None, 7: " \n\t\n", 8: "one two", 9: "one two",
             10: "\n".join(prose(i, 5) for i in range(6)), 11: "\n".join([prose(90, 4)] + [prose(i, 5) for i in range(4)]),
             12: "x" * 20_000 + " " + prose(3, 3_000), 13: "ÄÖÜ straße Élan 中文 👩‍👧 \x00 end", 14: base.upper()}
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t), 0.1, "a", "r", "n") for i, t in texts.items()]
    rows += [rows[3], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows
