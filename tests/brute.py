"""Reference semantics by exhaustive search."""


def mappings(labels, edges, pattern, injective=True):
    """All label-preserving maps of the pattern into the graph, as tuples in the pattern's order."""
    near = {v: set() for v in labels}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    ids, out = list(pattern.labels), []

    def go(done):
        if len(done) == len(ids):
            out.append(tuple(done))
            return
        u = ids[len(done)]
        for v in labels:
            if labels[v] != pattern.labels[u] or (injective and v in done):
                continue
            if all(done[i] in near[v] for i, w in enumerate(ids[: len(done)]) if pattern.has_edge(u, w)):
                go([*done, v])

    go([])
    return out
