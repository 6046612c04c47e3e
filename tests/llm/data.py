"""Small tables with every awkward case."""

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, part string, tokens string"
TEXTS = [
    None, "", " ", "\n\n\t", "one", "Same text twice here", "Same text twice here", "Ünïcode Œuvre ǅ ΣΑΣ \u00a0 x\u2003y\x1cz\x85w", "a\t  b \n\n c  ",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "don't WON'T it's 12345 !!! ### e\u0301 \U0001f600\U0001f468\u200d\U0001f469", "\\ <| <\\| \\0 \\n <|im_end|>",
    "word " * 5000 + "end", "x" * 20000, "line\r\nwith WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n",
]


def documents(spark, texts=TEXTS, first=0):
    """The texts under ids from `first`, a repeated row, a null id, and columns of clashing names."""
    rows = [(first + k, t, None, "src0", None, "s", "p", "t") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[-1:], (None, "no id", None, None, None, None, None, None)], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, links):
    """The smallest node reachable from each."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
