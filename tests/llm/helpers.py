"""Documents with nulls, empties, a very long text, repeats and columns that clash with results."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, predicted int, rep string, n_tokens string"
EN = "The cat of the house and the dog that was with it in the garden as the sun is on for a day. "


def rows(texts, start=0):
    return [(start + i, t, "en", "src", None if t is None else len(t), 7.0, None, 9, "x", "y") for i, t in enumerate(texts)]


def edge_docs(spark):
    texts = [EN * 4, None, "", " \t\n ", "12 34 $$$ !!", EN * 4, "one two", "é" * 50, EN * 2000 + "end", "a" * 3000, "\n\n" * 40, EN * 4 + " more", "\x00 odd ▁ 日本 😀"]
    data = rows(texts)
    data.append(data[0])  # a repeated row
    data.append((None, EN * 3, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
