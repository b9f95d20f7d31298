def rows(df, *columns):
    """Sorted tuples of a small result."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def log(spark, histories):
    """An interaction log from ``{user: [item, ...]}``, in order, with time = place."""
    data = [(u, i, at, at) for u, items in histories.items() for at, i in enumerate(items)]
    return spark.createDataFrame(data, "user_id long, item_id long, timestamp long, row_ord long")
