def edit_distance(item, text, most):
    """Whether some stretch of text is within this edit distance of item, by the plain recurrence; texts that share no word run are told at once."""
    if not set(item) & set(text) or len(item) - most > sum(w in set(text) for w in item):
        return False
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= most


def union_find(n: int, left, right):
    """Components of a small local graph: the smallest index reachable from each of n nodes."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(left, right, strict=True):
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
