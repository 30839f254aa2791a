"""Hand-made documents with the cases that every operator must stand: nulls, empty and long texts, ties, extra columns."""

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a  b", "\n\nx  y\n", " lead", "trail ", "tab\t x", "x\x1cy z", "é   q", "a\x01b \x01 c", "Don't 'tis  <|endoftext|> 12345", "\n", " ", "x \n y", "one two three", "one two three"]


def odd_docs(spark, texts=None):
    """doc_id, text and columns whose names clash with those that operators make."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, 7, "x", 2) for i, t in enumerate(ODD if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words int, kind string, part int")


def sample_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
