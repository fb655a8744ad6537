"""Scalar Column functions (text cleaning, classes, text builders)."""

from pawgrid.functions.classes import (  # noqa: F401
    age_bucket, age_in_months, age_months_text, age_phrase, birth_parts, clean_positive_number,
    size_class_a, size_class_b, size_class_c, strict_double,
)
from pawgrid.functions.describe import (  # noqa: F401
    candidate_text, describe_listing, embedding_text, get_or, with_description, with_embedding_text,
)
from pawgrid.functions.text import (  # noqa: F401
    any_two_way, clean_query, clean_text, contains_any, format_fixed, is_blank, pystrip, strip_hashtags,
    tag_text, truncate, two_way_contains,
)
