"""functions of the phishing analytics library."""
