"""DataFrame-in, DataFrame-out operators for engine-evaluated chess positions and model replies."""
