"""Rows that every operator on documents has to cope with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéou") for _ in range(r.randint(1, 7))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, one long text and repeated rows."""
    base, shared = prose(1, 120), prose(2, 60)
    words = base.split()
    near = [" ".join([*words[:i], f"edit{i}", *words[i + 1 :]]) for i in range(20, 60)]
    rows = [(0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.upper(), "en", "b", 1)]
    rows += [(10 + i, t, "fr", "a", 1) for i, t in enumerate(near)]
    rows += [(100 + i, f"{prose(50 + i, 40 + i)}\n{shared} {prose(80 + i, 30)}", "de", f"s{i % 3}", 1) for i in range(12)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n\x0b\x0c\r ", "en", None, 0), (203, "one", "en", "a", 3), (204, "one two\x85three", "en", "b", 3), (205, "1234 5678 !!", "en", "c", 3)]
    rows += [(300, prose(300, 30000), "es", "big", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (301, "don't\u00a0stop  \n\n now\u3000🙂 ½ x", "en", "c", 9)]
    rows += [(302, "a b c a b c a b c\nsame line here\nsame line here\n\nsame line here", "en", "c", 9), (303, prose(303, 70), "en", "c", 9), (303, prose(304, 70), "en", "c", 9), (303, prose(303, 70), "en", "c", 9)]
    return rows
