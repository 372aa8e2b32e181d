"""Exception classes of the library, one per kind of refusal."""


class PolyadError(ValueError):
    """Base class; catch it to catch every refusal of the library."""


class BadInput(PolyadError):
    """An argument is outside its domain."""


class LongFormat(PolyadError):
    """A long event table was passed where wide sequences are expected."""


class MissingColumn(PolyadError):
    """A named column does not exist."""


class UnparsedTime(PolyadError):
    """No known format reads the time strings."""


class OutsideObservation(PolyadError):
    """A measuring point lies outside the declared observation."""


class DenseTooLarge(PolyadError):
    """A verb that is dense by definition got more nodes than its guard allows."""


class Disconnected(PolyadError):
    """The hypergraph must be connected for this verb."""


class NotErgodic(PolyadError):
    """The chain is reducible."""


class NoConverge(PolyadError):
    """An iteration did not reach its tolerance."""


class EmptyCorpus(PolyadError):
    """No token is left."""


class EmptyResult(PolyadError):
    """Nothing is left to compute on."""


class TooManyPaths(PolyadError):
    """Path enumeration passed its bound."""


class NonpositiveSimilarity(PolyadError):
    """A selected neighbour has no positive similarity."""
