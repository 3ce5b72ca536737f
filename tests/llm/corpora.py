"""Small tables with the cases that every corpus operator has to bear."""
import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
CLASH = "bits long, spans string, items string, score double, part int, ids string, p double, n_tokens long, row string"

WORDS = {"en": "the of and to house river stone walk never garden".split(),
         "fr": "le la de et à maison rivière pierre été jardin".split(),
         "de": "der die das und zu haus fluß stein über garten".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(seed=1, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = sentence(rng, lang, rng.randint(1, 60))
        if rows and rng.random() < 0.2:
            _, text, lang, _, _ = rng.choice(rows)
        if rows and rng.random() < 0.1:
            _, text, lang, _, _ = rng.choice(rows)
            text += " " + rng.choice(WORDS[lang])
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    rows += [
        (n, None, "en", "src0", None), (n + 1, "", None, None, 0), (n + 2, "  \n\t ", "en", "src1", 5),
        (n + 3, "12 34 !!", "en", "src1", 8), (n + 4, "x" * 5000, "en", "src1", 5000),
        (n + 5, sentence(rng, "en", 20_000), "en", "src2", 1), (n + 6, "É ÉTÉ ß <|endoftext|> it's", "fr", "src2", 1),
        (None, "a row without an id", "en", "src2", 1), (3, rows[3][1], rows[3][2], "src0", 1),
        (3, rows[3][1], rows[3][2], "src0", 1)]
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, COLUMNS)
    if not clash:
        return df
    return df.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", ")))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
