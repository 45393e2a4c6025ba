"""Small document tables with the hard cases every operator must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]); extra adds columns whose names clash with internal ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("id", "rep", "key", "fp", "node", "root", "size", "h", "start", "slot", "component", "length", "bin", "_id", "_hash", "_dk", "_DOC", "_of", "_spans", "_source", "_size", "_words", "_times", "_nth", "_kept_id", "a.b"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


WORDS = "red green blue stone river cloud field light water grass tree wind sand hill bird".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def hard_rows():
    long = prose(1, 30_000)
    base = prose(2, 150)
    near = base.replace(base.split()[70], "changed", 1)
    return [
        (0, None), (1, ""), (2, "   \n\t"), (3, "one two three"), (4, base), (5, base), (5, base), (6, near),
        (7, long), (8, prose(3, 80)), (None, base), (9, "ÄÖ Über straße 漢字 \u0000 x"), (10, prose(3, 80) + " tail"),
        (11, "a " * 400), (12, "-" * 3000), (-5, prose(4, 120)), (13, prose(4, 119)),
    ]
