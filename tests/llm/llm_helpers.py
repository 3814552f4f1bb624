import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_text(random, n, vocabulary=400):
    return " ".join(f"w{random.randrange(vocabulary)}" for _ in range(n))
