"""Small awkward tables for the operators of the llm subpackage."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string"


def awkward_texts(seed=3):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "tion", "ering", "thé", "naïve", "x" * 60, "α", "日本", "a.b", "9", "ñ,"]
    passage = " ".join(rng.choice(vocab) + str(i % 7) for i in range(40))
    texts = [None, "", " ", "\n\n\n", "one", "one two", "one two three", passage, passage, passage + " tail"]
    texts += [" ".join(passage.split()[3:25]), "head " + " ".join(passage.split()[5:18]) + " end"]
    texts += ["a a a a a a a a a a a a a a a a a a a a", "line one\nline one\n\nline one\r\nline\tone\n  \nline one"]
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  ", "\x0b", " ", " "]) for w in words))
    texts.append(" ".join(rng.choice(vocab) + rng.choice("0123456789") for _ in range(20000)))
    return texts


def docs(spark, texts=None, ids=None):
    texts = awkward_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, [None, "en"][k % 2], [None, "s1", "s2", ""][k % 4], None, 0.5, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
