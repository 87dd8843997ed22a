"""Set-oriented operators: cleaning, time series, scaling, neighbours, planning."""
