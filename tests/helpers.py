"""Small inputs for tests."""


def lines_frame(spark, files, partitions=None):
    """Lines of ``{file: text}``."""
    from loglattice.sources.lines import lines_of

    df = spark.createDataFrame(list(files.items()), "file_id string, text string")
    if partitions:
        df = df.repartition(partitions)
    return lines_of(df, "file_id", "text")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
