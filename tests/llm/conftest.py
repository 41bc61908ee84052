import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {
    "en": "the and ing ion ent her tha ere wh ou sh th".split(),
    "de": "der die und ein sch ung lich keit zu ver auf ge".split(),
    "fr": "les que eau ment tion aux oui eux ch ai un elle".split(),
    "es": "los que ción mente ado ñ arr ll osa el ci ue".split(),
}


def prose(random_, lang, words):
    parts = SYLLABLES[lang]
    return " ".join("".join(random_.choices(parts, k=random_.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, repeated rows and ids, odd blanks, nulls and a very long text."""
    r = random.Random(3)
    langs = ["en", "de", "fr", "es"]
    texts = [(prose(r, langs[i % 4], r.randint(1, 120)), langs[i % 4]) for i in range(120)]
    for i in range(20):
        words = texts[i][0].split(" ")
        if len(words) > 40:
            words[len(words) // 2] = "changed"
        texts.append((" ".join(words), texts[i][1]))
    texts += [texts[4], texts[4], texts[4]]
    passage = prose(r, "en", 60)
    texts += [(f"{prose(r, 'en', 20)} {passage} {prose(r, 'en', 9)}", "en") for _ in range(6)]
    texts += [(prose(r, "en", 20_000), "en")]
    odd = [
        "", " ", "\n\n", "a  b", "a\n \nb", "\tx \n y ", "Ünï Ç漢字 　 \U0001F600!", "A" * 5_000, "1 2 3", "....", "ab", "x",
        "mail a.b@c.de and ..@x.y z@q 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 010-9999",
        "'s 'll don't  's", "ＦＵＬＬ wide", "it's <|endoftext|>",
    ]
    out = [(i, t, lang, "src", len(t)) for i, (t, lang) in enumerate(texts)]
    out += [(1_000 + i, t, None, None, None) for i, t in enumerate(odd)]
    out += [(2_000, None, "en", None, None), (2_001, None, None, None, None), (5, out[5][1], "de", "src", 1), (5, "other text of one id", "en", "s", 2)]
    out += [(None, "no id at all here", "en", None, 3), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Documents whose other columns are called like columns of the operators."""
    from pyspark.sql import functions as F

    names = "h n f c sig size row rank offset bucket shard slot label key maybe spans items base near term value code part"
    return docs.withColumns({c: F.lit(1) for c in names.split()})
