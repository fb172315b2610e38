"""What a fit can fail with."""


class RegressionError(ValueError):
    """Base of all."""


class DimensionMismatch(RegressionError):
    pass


class InsufficientObservations(RegressionError):
    pass


class SingularMatrix(RegressionError):
    pass


class AllFeaturesConstant(RegressionError):
    pass


class InvalidOptions(RegressionError):
    pass


class ConvergenceFailed(RegressionError):
    pass


class InvalidWeights(RegressionError):
    pass


class NumericalError(RegressionError):
    pass


class NaError(RegressionError):
    """Missing values that the policy does not allow."""


class NaValuesPresent(NaError):
    pass


class AllNa(NaError):
    pass


class InsufficientAfterNa(NaError):
    pass
