"""What can go wrong. A missing key is an empty result, not an error."""


class StoreError(Exception):
    pass


class Corruption(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class Conflict(InvalidArgument):
    """Another writer has committed first."""


class NotSupported(StoreError):
    pass
