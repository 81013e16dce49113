"""Plain spellings of ids, digests, components and splits, as the core has them."""

from ..functions.spelling import EMPTY_SHA256, SHORTEST_DIGEST, SPLITS, plain_component, plain_digest, plain_id, plain_image, plain_split

__all__ = ["EMPTY_SHA256", "SHORTEST_DIGEST", "SPLITS", "plain_component", "plain_digest", "plain_id", "plain_image", "plain_split"]
