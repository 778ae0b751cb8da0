"""Plain versions of what several tests count."""


def brute_words(text):
    out, word = [], []
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c)
    return out
