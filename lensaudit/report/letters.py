"""Letters as dots, five across and seven down, for charts as pictures."""

from __future__ import annotations

import numpy as np

#: For each printable ASCII character its five columns, from the left, as hexadecimal numbers whose lowest bit is the top dot.
_COLUMNS = r"""
      00 00 00 00 00
    ! 00 00 5F 00 00
    " 00 07 00 07 00
    # 14 7F 14 7F 14
    $ 24 2A 7F 2A 12
    % 23 13 08 64 62
    & 36 49 56 20 50
    ' 00 00 07 00 00
    ( 00 1C 22 41 00
    ) 00 41 22 1C 00
    * 2A 1C 7F 1C 2A
    + 08 08 3E 08 08
    , 00 50 30 00 00
    - 08 08 08 08 08
    . 00 60 60 00 00
    / 20 10 08 04 02
    0 3E 51 49 45 3E
    1 00 42 7F 40 00
    2 42 61 51 49 46
    3 21 41 45 4B 31
    4 18 14 12 7F 10
    5 27 45 45 45 39
    6 3C 4A 49 49 30
    7 01 71 09 05 03
    8 36 49 49 49 36
    9 06 49 49 29 1E
    : 00 36 36 00 00
    ; 00 56 36 00 00
    < 08 14 22 41 00
    = 14 14 14 14 14
    > 00 41 22 14 08
    ? 02 01 51 09 06
    @ 32 49 79 41 3E
    A 7E 11 11 11 7E
    B 7F 49 49 49 36
    C 3E 41 41 41 22
    D 7F 41 41 22 1C
    E 7F 49 49 49 41
    F 7F 09 09 09 01
    G 3E 41 49 49 7A
    H 7F 08 08 08 7F
    I 00 41 7F 41 00
    J 20 40 41 3F 01
    K 7F 08 14 22 41
    L 7F 40 40 40 40
    M 7F 02 0C 02 7F
    N 7F 04 08 10 7F
    O 3E 41 41 41 3E
    P 7F 09 09 09 06
    Q 3E 41 51 21 5E
    R 7F 09 19 29 46
    S 46 49 49 49 31
    T 01 01 7F 01 01
    U 3F 40 40 40 3F
    V 1F 20 40 20 1F
    W 3F 40 38 40 3F
    X 63 14 08 14 63
    Y 07 08 70 08 07
    Z 61 51 49 45 43
    [ 00 7F 41 41 00
    \ 02 04 08 10 20
    ] 00 41 41 7F 00
    ^ 04 02 01 02 04
    _ 40 40 40 40 40
    ` 00 01 02 04 00
    a 20 54 54 54 78
    b 7F 48 44 44 38
    c 38 44 44 44 20
    d 38 44 44 48 7F
    e 38 54 54 54 18
    f 08 7E 09 01 02
    g 0C 52 52 52 3E
    h 7F 08 04 04 78
    i 00 44 7D 40 00
    j 20 40 44 3D 00
    k 7F 10 28 44 00
    l 00 41 7F 40 00
    m 7C 04 18 04 78
    n 7C 08 04 04 78
    o 38 44 44 44 38
    p 7C 14 14 14 08
    q 08 14 14 18 7C
    r 7C 08 04 04 08
    s 48 54 54 54 20
    t 04 3F 44 40 20
    u 3C 40 40 20 7C
    v 1C 20 40 20 1C
    w 3C 40 30 40 3C
    x 44 28 10 28 44
    y 0C 50 50 50 3C
    z 44 64 54 4C 44
    { 00 08 36 41 00
    | 00 00 7F 00 00
    } 00 41 36 08 00
    ~ 08 04 08 10 08
"""
_LETTERS = {line[4]: [int(x, 16) for x in line[6:].split()] for line in _COLUMNS.strip("\n").splitlines()}
#: What stands for all other characters: a frame.
_OTHER = [127, 65, 65, 65, 127]


def bitmap(text: str) -> np.ndarray:
    """Dots of a line of text, 7 x 6 a letter, the last column of each left empty; no columns for no text."""
    columns = [c for letter in text for c in (*_LETTERS.get(letter, _OTHER), 0)]
    return (np.array(columns, np.int64)[None, :] >> np.arange(7)[:, None] & 1).astype(bool)
