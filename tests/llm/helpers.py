KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"


def documents(spark, texts, start=0):
    """A documents table with extra columns whose names clash with the operators' own."""
    rows = [(i + start, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def smallest(nodes, links):
    """The smallest node that each reaches."""
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}
