"""What a guard raises."""


class Refused(ValueError):
    """The input breaks a rule, and no partial answer is given."""
