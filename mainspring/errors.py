"""Errors of sources, copybooks, layouts and encodings; those of records are raised while a plan is made."""


class MainframeError(ValueError):
    """Base of all errors below."""


class EmptyPictureError(MainframeError):
    pass


class UnexpectedSymbolError(MainframeError):
    pass


class RepeatCountError(MainframeError):
    pass


class SymbolPlacementError(MainframeError):
    pass


class CategoryError(MainframeError):
    pass


class UnexpectedCharacterError(MainframeError):
    pass


class UnterminatedStringError(MainframeError):
    pass


class UnterminatedPseudoTextError(MainframeError):
    pass


class UnexpectedEndOfTokensError(MainframeError):
    pass


class UnexpectedTokenError(MainframeError):
    pass


class UnexpectedKeywordError(UnexpectedTokenError):
    """A word stands where one of a few others should."""


class SearchAllConstraintError(UnexpectedTokenError):
    """SEARCH ALL with another WHEN than one of equalities and condition-names joined by AND."""


class UnsupportedNodeError(MainframeError):
    """A tree holds a node that has no printed form."""


class TrailingTokenError(MainframeError):
    pass


class InvalidLevelNumberError(MainframeError):
    pass


class CopyBookNotFoundError(MainframeError):
    pass


class CopyBookCycleError(MainframeError):
    pass


class MissingCopyBookResolverError(MainframeError):
    pass


class LevelError(MainframeError):
    pass


class LevelSequenceError(MainframeError):
    pass


class RenamesError(MainframeError):
    pass


class PictureError(MainframeError):
    pass


class UsageError(MainframeError):
    pass


class DialectError(MainframeError):
    pass


class LayoutError(MainframeError):
    pass


class OccursError(MainframeError):
    pass


class RedefinesError(MainframeError):
    pass


class OccurrenceError(MainframeError):
    pass


class DependingError(MainframeError):
    pass


class EncodingError(MainframeError):
    pass


class DigitCountError(MainframeError):
    pass
