"""A small corpus with copies, near copies, shared passages, junk and odd rows."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an on the er in re ed nd ha to en is it of ou ing tion éa ñü".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, place double, path string"


def sentence(rng, n):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def texts(seed=1):
    rng = random.Random(seed)
    base = ["\n".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(3, 12))) for _ in range(40)]
    passage = " ".join(sentence(rng, 12) for _ in range(7))
    out = list(base)
    out += [base[0]] * 5 + [base[1].upper()] + [base[2].replace(" ", "  ")]
    for i in range(3, 9):
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [base[i] + "\n" + passage + "\n" + base[i + 1][::-1] for i in range(10, 16)]
    out += ["spam " * 300, "a" * 900, "### buy $$$ now *** " * 30, "one two three", "one two three", "x", "", "  \n\t ", None, None]
    out += [sentence(rng, 30000)]
    return out


def rows(seed=1):
    """Documents; ids are shuffled, one row is repeated whole, one id is null, one is used twice."""
    rng = random.Random(seed + 1)
    all_texts = texts(seed)
    ids = list(range(100, 100 + len(all_texts)))
    rng.shuffle(ids)
    out = []
    for k, (i, t) in enumerate(zip(ids, all_texts, strict=True)):
        out.append((i, t, [None, "en", "fr", "en"][k % 4], [None, "b", "a", "a", "a"][k % 5], None, 1, "x", 0.5, "/p"))
    out.append(out[3])
    out.append((None, "A text without an id, long enough to have a few words in it.", "en", "a", 1, 1, "x", 0.5, "/p"))
    out.append((out[4][0], "The same id with another text, again of a few words.", "en", "c", 1, 1, "x", 0.5, "/p"))
    return out


def words(text):
    return WORD.findall(text or "")
