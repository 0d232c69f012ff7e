"""A small corpus with the cases that operators must bear."""

import random

LANGS = {
    "en": "the of and to in is was for that with on by this from have not are were they which".split(),
    "fr": "le la les des une et est dans pour que qui sur avec pas plus par sont été mais nous".split(),
    "de": "der die das und ist nicht ein eine mit auf für von dem den sich auch werden wird bei aus".split(),
}
ENDINGS = {"en": ["ing", "tion", "ed", "ly"], "fr": ["ement", "eux", "ique", "oir"], "de": ["ung", "keit", "lich", "isch"]}
INSULTS, GROUPS = ["grobnik", "zwerbel"], ["uplanders", "lowlanders"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, spans int, ids string, family double, h string, rep int, near boolean"


def prose(rnd: random.Random, lang: str, n: int) -> str:
    out = []
    for i in range(n):
        word = rnd.choice(LANGS[lang]) if rnd.random() < 0.45 else "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) + rnd.choice(ENDINGS[lang])
        out.append(word + ("." if rnd.random() < 0.1 else "") + ("\n" if rnd.random() < 0.04 else " "))
    return "".join(out).strip()


def corpus(n: int = 160, seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang): prose, copies, near copies, shared passages, odd texts, nulls."""
    rnd = random.Random(seed)
    rows, passage = [], prose(rnd, "en", 40)
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        text = prose(rnd, lang, rnd.randint(12, 220))
        kind = i % 8
        if kind == 1 and i > 20:
            text = rows[rnd.randrange(i)][1] or text
        elif kind == 2 and i > 20:
            words = (rows[rnd.randrange(i)][1] or text).split(" ")
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        elif kind == 4 and i % 16 == 4:
            text += "\n" + "\n".join(["the same line again and again here"] * 6)
        rows.append((i, text, lang))
    odd = ["", " ", "\n\n\t", "a", "one two three", "ONE two three", "x" * 3000, "ab" * 700, "é漢字😀 " * 40, "\0 nul \x1c\x85 and   blanks  twice\r\n", "###$$$ %%% &&& ||| <> " * 8, "<|endoftext|> inside <s> </s>", "12345 67890"]
    rows += [(n + i, t, "en") for i, t in enumerate(odd)]
    rows += [(n + 50, None, "en"), (n + 51, "the text of no language and of that", None), (n + 52, None, None), (None, prose(rnd, "en", 30), "en"), (n + 53, prose(rnd, "de", 6000), "de")]
    repeated = rows[5]
    return [*rows, repeated]


def frame(spark, rows):
    full = [(i, t, lang, f"src{(i or 0) % 3}", len(t) if t is not None else None, "clash", 1, "clash", 0.5, "clash", 7, None) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
