"""Slow and plain versions of what the engine computes, for tests."""

from palimpsest.functions.tokens import BYTES, LOWER

LETTER = BYTES | {c: c for c in LOWER}


def tokens(data: bytes) -> set[str]:
    out, run = set(), ""
    for byte in data:
        letter = LETTER.get(chr(byte))
        if letter:
            run += letter
            continue
        if 4 < len(run) < 15:
            out.add(run)
        run = ""
    if 3 < len(run) < 20:
        out.add(run)
    return out


OPS = ("and", "or", "not")


def answer(index: dict[int, set[str]], typed: str, min_char: int = 4) -> dict[int, int]:
    """Two passes over the query: collect terms, then evaluate with a stack of sets."""
    text = f"({typed})"
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return {}
    if depth:
        return {}
    known, run, quoted = set(), "", False
    for c in text + " ":
        if c == '"':
            if not quoted:
                quoted = True
            elif 2 < len(run) < 254:
                known.add((run, True))
                run, quoted = "", False
            continue
        letter = LETTER.get(c)
        if letter:
            run += letter
        elif run in OPS:
            run = ""
        elif 3 < len(run) < 254:
            known.add((run, False))
            run = ""

    def look(word: str, exact: bool) -> dict[int, int]:
        if exact:
            return {d: 1 for d, ws in index.items() if word in ws}
        if len(word) <= min_char:
            return {}
        hits = {d: sum(w.startswith(word) for w in ws) for d, ws in index.items()}
        return {d: n for d, n in hits.items() if n}

    stack: list[list] = []
    groups: list[dict] = []
    run, quoted = "", False

    def flush() -> None:
        nonlocal run
        if run in OPS:
            if stack:
                stack[-1].append(run)
            run = ""
        elif 3 < len(run) < 254:
            if (run, False) in known and stack:
                stack[-1].append(look(run, False))
            run = ""

    for c in text:
        if c == "(":
            stack.append([])
        elif c == ")":
            flush()
            result, op = {}, "or"
            for item in stack.pop():
                if isinstance(item, str):
                    op = op if item == "or" else item
                    continue
                if op == "and":
                    result = {d: n + item[d] for d, n in result.items() if d in item}
                elif op == "not":
                    result = {d: n for d, n in result.items() if d not in item}
                else:
                    result = {d: result.get(d, 0) + item.get(d, 0) for d in result.keys() | item.keys()}
                op = "or"
            stack[-1].append(result) if stack else groups.append(result)
        elif c == '"' and not quoted:
            quoted = True
        elif c == '"' and 2 < len(run) < 254:
            if (run, True) in known and stack:
                stack[-1].append(look(run, True))
            run, quoted = "", False
        elif c in LETTER:
            run += LETTER[c]
        else:
            flush()
    return groups[0]
