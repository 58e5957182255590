"""All named queries."""

from swayline.plans import descriptive, models

QUERIES = {**descriptive.QUERIES, **models.QUERIES}
