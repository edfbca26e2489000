"""Versions and ranges by plain Python, against which the columns of ``functions/versions.py`` are held."""

import re

_STAGES = {"dev": -4, "a": -3, "alpha": -3, "b": -2, "beta": -2, "c": -1, "rc": -1, "pre": -1, "preview": -1}


def pypi_key(v: str) -> tuple | None:
    """Order of a Python version: epoch, release without trailing zeros, then dev, pre-release, final and post stages by number; None if it is none."""
    m = re.fullmatch(r"v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?(\d*))?(?:[-_.]?(post|rev|r)[-_.]?(\d*)|-(\d+))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?", v.strip().lower())
    if not m:
        return None
    number = lambda i: int(m[i] or 0)
    release = tuple(int(x) for x in m[2].split("."))
    while len(release) > 1 and release[-1] == 0:
        release = release[:-1]
    post = (number(6) if m[5] else int(m[7])) if m[5] or m[7] else -1
    stage = (_STAGES[m[3]], number(4)) if m[3] else (_STAGES["dev"], 0) if m[8] and post < 0 else (0, 0)
    local = tuple((1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"[-_.]", m[10])) if m[10] else ()
    return int(m[1] or 0), release, stage, post, (0, number(9)) if m[8] else (1, 0), local


def _is_pre(key: tuple) -> bool:
    return key[2] < (0, 0) or key[4][0] == 0


def pypi_fits(v: str, specifier: str) -> bool:
    """Whether a version satisfies every clause; ValueError for what is no specifier."""
    key = pypi_key(v)
    for clause in filter(None, (c.strip() for c in specifier.split(","))):
        m = re.fullmatch(r"(===|==|!=|~=|<=|>=|<|>)\s*(\S+)", clause)
        if not m:
            raise ValueError(specifier)
        op, other = m[1], m[2]
        wild = other.endswith(".*")
        o = pypi_key(other.removesuffix(".*"))
        if o is None or (wild and op not in ("==", "!=")):
            raise ValueError(specifier)
        parts = [int(x) for x in re.match(r"v?(?:\d+!)?([\d.]*\d)", other.lower())[1].split(".")]
        begins = lambda n: list(key[1] + (0,) * n)[:n] == parts[:n] and key[0] == o[0]
        public = key if o[5] else (*key[:5], ())
        if op == "===":
            ok = v == other
        elif wild:
            ok = begins(len(parts)) == (op == "==")
        elif op == "~=":
            if len(parts) < 2:
                raise ValueError(specifier)
            ok = public >= o and begins(len(parts) - 1)
        elif op == ">":  # not of the same release by a post-release or a local part alone
            ok = key > o and not (key[:3] == o[:3] and o[3] < 0 and (key[3] >= 0 or key[5]))
        elif op == "<":  # nor a pre-release of the version itself
            ok = key < o and not (_is_pre(key) and not _is_pre(o) and key[:2] == o[:2])
        else:
            ok = {"==": public == o, "!=": public != o, ">=": public >= o, "<=": public <= o}[op]
        if not ok:
            return False
    return True


def npm_key(v: str) -> tuple | None:
    """Order of a semantic version: three numbers, then pre-releases before the final one, their parts by number or text."""
    m = re.fullmatch(r"[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?", v.strip())
    if not m:
        return None
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else ()
    return (int(m[1]), int(m[2]), int(m[3])), (0, pre) if pre else (1, ())


def _partial(text: str) -> tuple[list[int], tuple | None]:
    """The numbers that a partial version gives (``1.x`` gives one) and, of a full one, its key."""
    text = text.strip().lstrip("v=")
    key = npm_key(text)
    if key:
        return list(key[0]), key
    m = re.fullmatch(r"(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?", text)
    if m is None:
        raise ValueError(text)
    numbers = []
    for x in m.groups():
        if x is None or not x.isdigit():
            break
        numbers.append(int(x))
    return numbers, None


def _npm_bounds(op: str, text: str) -> tuple[tuple, tuple | None]:
    """(low, high): keys from low on and below high satisfy the comparator."""
    numbers, key = _partial(text)
    start = lambda n: (tuple((list(n) + [0, 0, 0])[:3]), (0, ()))  # noqa: E731  before all pre-releases
    next_ = lambda n: start([*n[:-1], n[-1] + 1]) if n else None
    low = key or start(numbers)
    nothing = (start([]), start([]))
    if op in ("", "="):
        return (key, (key[0], (*key[1], 0))) if key else (low, next_(numbers))
    if op == ">=":
        return low, None
    if op == "<":
        return start([]), key or (start(numbers) if numbers else start([]))
    if op == "<=":
        return start([]), (key[0], (*key[1], 0)) if key else next_(numbers)
    if op == ">":
        return ((key[0], (*key[1], 0)), None) if key else (next_(numbers), None) if numbers else nothing
    if op == "^":
        at = next((i for i, x in enumerate(numbers) if x), len(numbers) - 1)
        return low, next_(numbers[: at + 1]) if numbers else None
    return low, next_(numbers[:2]) if numbers else None  # ~


def npm_fits(v: str, specifier: str) -> bool:
    """Whether a version is in one of the ranges that ``||`` separates; ValueError for what is no range.

    A pre-release fits only a range that names a pre-release of the same three numbers.
    """
    key = npm_key(v)
    for range_ in specifier.split("||"):
        between = re.fullmatch(r"\s*(\S+)\s+-\s+(\S+)\s*", range_)
        tokens = [(">=", between[1]), ("<=", between[2])] if between else re.findall(r"(>=|<=|>|<|=|\^|~>?)?\s*([^\s<>=^~]+)", range_) or [("", "")]
        bounds = [_npm_bounds(op.rstrip(">") if op.startswith("~") else op, text) for op, text in tokens]
        inside = all(low <= key and (high is None or key < high) for low, high in bounds)
        named = key[1][0] == 1 or any((k := _partial(text)[1]) and k[1][0] == 0 and k[0] == key[0] for _, text in tokens)
        if inside and named:
            return True
    return False


def best_version(versions: list[str], specifier: str | None, npm: bool = False, latest: str | None = None) -> str | None:
    """The highest version that satisfies ``specifier``; of Python versions a stable one if there is any, else a pre-release.

    No specifier, an invalid one, and one of npm that names no registry version give ``latest``, or else the highest stable version.
    """
    of, fits = (npm_key, npm_fits) if npm else (pypi_key, pypi_fits)
    pre = (lambda k: k[1][0] == 0) if npm else _is_pre
    known = sorted((v for v in versions if of(v)), key=of)
    latest = latest or ([v for v in known if not pre(of(v))] or known or [None])[-1]
    said = (specifier or "").strip()
    if said in ("", "*", "latest") or (npm and (re.match(r"(git\+|git:|https?://|file:|npm:)", said.lower()) or "/" in said)):
        return latest
    try:
        found = [v for v in known if fits(v, said)]
    except ValueError:
        return latest
    return ([v for v in found if npm or not pre(of(v))] or found or [None])[-1]
