"""The small labelled URL table that the URL model is trained on: 1 to block, 0 to allow.

Names are put together from two lists of words each, so that a name's parts and not the name itself are what is learned.
"""

#: Words of sites that sell, gamble or trick, and of what they sell.
_BAD = (
    ("cheap", "free", "buy", "hot", "win", "fast", "best", "instant", "secret", "bonus"),
    ("pills", "casino", "spam", "adult", "xxx", "loans", "viagra", "slots", "poker", "betting", "replica", "lottery", "porn", "crypto"),
)
#: Words of ordinary sites.
_GOOD = (
    ("city", "north", "river", "green", "open", "daily", "old", "royal", "central", "little"),
    ("library", "museum", "garden", "history", "science", "recipes", "weather", "school", "theatre", "almanac", "journal", "music", "village", "winter"),
)
#: Syllables for names without a meaning, which are allowed.
_PLAIN = ("an", "er", "in", "on", "re", "st", "th", "ou", "ed", "ti", "al", "en", "or", "ha", "nt", "is")
_FRONT = ("", "www.", "m.", "blog.")
_TOP = ("com", "net", "org")
_PATH = ("/en/12", "/de/345.html", "/fr/67/", "/es/890", "/about", "/")


def names() -> list[tuple[str, int]]:
    """Every pair of words in either order, and as many names of syllables."""
    out = []
    for label, (first, second) in ((1, _BAD), (0, _GOOD)):
        for i, a in enumerate(first):
            for j, b in enumerate(second):
                out.append((f"{a}-{b}" if (i + j) % 2 else f"{b}-{a}", label))
    n = len(_PLAIN)
    for i in range(n):
        for j in range(n):
            out.append((_PLAIN[i] + _PLAIN[j] + _PLAIN[(3 * i + 5 * j + 1) % n], 0))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """Each name under three of the fronts and ends, and a path, so that neither of those tells the classes apart."""
    out = []
    for i, (name, label) in enumerate(names()):
        for j in range(3):
            out.append((f"https://{_FRONT[(i + j) % len(_FRONT)]}{name}.example.{_TOP[(i + j) % len(_TOP)]}{_PATH[(i + 2 * j) % len(_PATH)]}", label))
    return out
