"""Random values that an assignment, a neighbour or their alphabet must not hide from the entropy pass."""

import random
import re
import string

from weftline.llm.secret_scan import ALLOWED, added_spans, base_spans

ALLOW = re.compile("|".join(f"(?:{a})" for a in ALLOWED))
DRAW = random.Random(1)


def drawn(alphabet, n=40):
    return "".join(DRAW.choice(alphabet) for _ in range(n))


def found(text):
    return [text[s:e] for s, _, e in added_spans(text, base_spans(text), ALLOW)]


def test_values_of_assignments():
    key = drawn(string.ascii_letters + string.digits + "+/")
    for text in (f"AWS_SECRET_ACCESS_KEY={key}", f"a {key}== b", f"X_EXAMPLE={key}", f"{key}=1234567890", f"example-{key}", f"AKIA{'Q7' * 8}={key}"):
        assert any(key[4:36] in f for f in found(text)), text


def test_alphabets():
    for alphabet in (string.ascii_lowercase + string.digits, string.ascii_letters):
        key = drawn(alphabet)
        assert found(f"see {key} here"), key


def test_public_shapes_stay():
    for text in (
        "integrity=sha256-" + drawn(string.ascii_letters + string.digits, 43) + "=", "id=123e4567-e89b-12d3-a456-426614174000", "docs/Some/Long/PathName/of2/TheThing9x/Readme",
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "getConfigurationPropertyFactoryInstance", "EXAMPLE_ACCESS_KEY_NAME_OF_A_SERVICE=abcdefgh0123456789",
    ):
        assert found(text) == [], text
