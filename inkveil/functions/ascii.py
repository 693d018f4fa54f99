"""Character classes.  All rules are ASCII; three notions of a word character differ.

Patterns are Java regular expressions over code points.  The byte rules they follow treat
every non-ASCII byte alike, so each class below has the same meaning by code point.
"""

#: Letters, digits: what patterns and labels must not touch.
ALNUM = "A-Za-z0-9"
#: The same with an underscore: national identifiers.
WORD = "A-Za-z0-9_"
#: Names: every non-ASCII character also counts as part of a word.
NAME = "A-Za-z0-9\\x{80}-\\x{10FFFF}"
#: Fuzzy words: letters, digits and apostrophes; non-ASCII breaks a word.
FUZZY = "A-Za-z0-9'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
