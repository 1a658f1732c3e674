"""Token ids of batches of whole texts with a bounded cache of the chunks between single spaces.

With the given pre-tokenizer pattern no match runs over a lone space or a lone line feed, so the text's ids are those of its chunks,
a chunk being what stands between two of them with the space in front. Texts with any other white space go through the pattern as they
are, and the matches are the chunks.
"""

#: Chunks remembered per task; the cache is emptied when it is full, which changes no result.
CACHE_SIZE = 300_000


class TextEncoder:
    """Packed little-endian 32-bit ids of texts. ``find_matches`` splits a text by the pattern, ``encode_matches`` maps a list of distinct matches to packed ids."""

    def __init__(self, find_matches, encode_matches):
        self.find_matches, self.encode_matches, self.cache = find_matches, encode_matches, {}

    def chunks(self, text):
        if text.split() != text.replace("\n", " ").split(" ") or "\0" in text:   # equal lists: every part is whole and free of other white space
            return self.find_matches(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, missing):
        """Ids of new chunks; a chunk of letters is a match by itself."""
        matches = [[c] if (c[1:] if c[0] == " " else c).isalpha() else self.find_matches(c) for c in missing]
        distinct = list({m for ms in matches for m in ms})
        ids = dict(zip(distinct, self.encode_matches(distinct)))
        for chunk, ms in zip(missing, matches):
            self.cache[chunk] = ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms])

    def encode_batch(self, texts):
        lists = [self.chunks(text) if text else [] for text in texts]
        wanted = set().union(*lists)
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_SIZE:
            self.cache.clear()
            missing = wanted
        self.learn(list(missing))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in lists]
