"""Small documents that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, _id string, fp string"
BARE = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words=9, alphabet="abcdefgh"):
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(words)]
    return " ".join(made).capitalize() + "."


def rows(n=40, seed=7):
    """(doc_id, text, lang, source, n_chars) rows with copies, near copies, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        text = "\n".join(" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
        made.append([i, text, ["en", "de", None][i % 3], ["a", "b", None, "ä"][i % 4]])
    made[5][1] = made[3][1]
    made[9][1] = made[3][1]
    made[11][1] = made[10][1].replace(" ", "  ", 1)
    made[12][1] = made[10][1] + " tail"
    made[14][1], made[15][1], made[16][1], made[17][1] = None, "", " \n\t ", "..."
    made[18][1] = " ".join(sentence(rng) for _ in range(300))
    made += [list(made[20]), list(made[20]), [None, made[21][1], "en", "a"], [None, None, None, None]]
    return [(*r, len(r[1] or "")) for r in made]


def docs(spark, given=None, extra=True):
    given = rows() if given is None else given
    if not extra:
        return spark.createDataFrame(given, BARE)
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in given], SCHEMA)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def in_duckdb(sql, documents, benchmark=()):
    """Rows of a registered SQL text over small tables, with their columns."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    table = pa.table([pa.array(list(c), k) for c, k in zip(zip(*documents) if documents else [[]] * 5, kinds)], names=names)
    items = pa.table([pa.array([b[0] for b in benchmark], pa.int64()), pa.array([b[1] for b in benchmark], pa.string())], names=["item_id", "text"])
    con.register("documents", table)
    con.register("benchmark", items)
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def same_as_sql(df, sql, documents, benchmark=()):
    names, found = in_duckdb(sql, documents, benchmark)
    assert sorted(names) == sorted(df.columns)
    assert values(df, *names) == sorted(found, key=repr)
