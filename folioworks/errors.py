"""What can go wrong, by kind."""


class FolioError(Exception):
    """Any error of this package."""


class UnsupportedFormatError(FolioError):
    """A file of a kind that nothing here reads."""


class ExtractionError(FolioError):
    """Text or elements couldn't be read."""


class LayoutError(FolioError):
    """A page's geometry couldn't be told."""


class SignalError(FolioError):
    """A document's signals couldn't be collected."""


class ImageError(FolioError):
    """An image couldn't be read or conditioned."""


class CacheError(FolioError):
    """The result cache couldn't be read or written."""
