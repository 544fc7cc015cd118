"""Documents that every operator has to take: nulls, empty and long texts, ties, repeated rows."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the quick brown fox jumps over lazy dogs while seven wizards mix potions and É ÀB ñandú ß").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


LONG = prose(1, 6000)
PASSAGE = prose(2, 60)


def cases() -> list[tuple]:
    texts = [
        None, "", " ", "\n", "one", "One TWO three", "ends in space ", "\ttab\tand\x0bvt", "日本 語 text é",
        prose(3, 30), prose(3, 30), prose(3, 30).upper(), prose(4, 200), prose(4, 200) + " tail", LONG,
        prose(5, 20) + "\n" + PASSAGE + "\n" + prose(6, 20), prose(7, 20) + "\n  " + PASSAGE.upper() + "\t\n" + prose(8, 9),
        PASSAGE + "\n" + PASSAGE + "\nx", "aaaa" * 200, "aaaa" * 200, PASSAGE[:10] + "\n" + PASSAGE, "<|endoftext|> a  b",
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, "another under id three " + PASSAGE, None, None, None), (None, PASSAGE, "en", None, 1)]
    rows += [(None, "no id either", "en", None, 1), rows[12], rows[14]]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(cases() if rows is None else rows, SCHEMA)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
