"""Helpers that several tests import."""


def by_source(corpus):
    out = {}
    for _, t, _, s in corpus:
        out[s] = out.get(s, 0) + len((t or "").split())
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_words long, size long, media string, Host string, n long, pages string, label long, times int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, src, None if t is None else len(t), 0.5, "x", 7, 9, "m", "h", 1, "p", 2, 3) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)
