"""Small documents with further columns whose names the operators use themselves."""

CLASHING = "id key row name level pos hash w doc node label held part queue hits spans shard depth record payload sha n score".split()


def maker(spark):
    def make(pairs):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
        rows = [(i, t, "en", None if k % 3 else "s", None, *([k] * len(CLASHING))) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
