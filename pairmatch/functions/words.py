"""Word lists used by the text functions.

The lists are fixed values: results depend on them word for word.
"""

from __future__ import annotations

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Stop words that carry meaning in a question and are therefore kept.
ALLOWED_STOP_WORDS = """
about after again all any as be been before being below between both but by can did do does doing
don down each few further had has have having here in just more most no not now off on once only
other out over own same so some such then there through too under up very while why will won
""".split()

# Numbers that are kept as tokens.
ALLOWED_NUMBERS = [
    str(n)
    for n in [
        *range(1, 102),
        *range(110, 201, 10),
        *range(300, 1001, 100),
        10_000,
        100_000,
        1_000_000,
    ]
]


def effective_stop_words(
    stop: list[str] = STOP_WORDS, allowed: list[str] = ALLOWED_STOP_WORDS
) -> list[str]:
    """The stop words that remain after the allowed ones are taken out."""
    return sorted(set(stop) - set(allowed))
