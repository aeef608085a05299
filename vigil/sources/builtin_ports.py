"""Ports that are watched unless a table says otherwise."""

from __future__ import annotations

# Port names for inbound flows.
INBOUND = {
    19: "chargen", 20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 69: "tftp", 80: "http", 88: "kerberos",
    110: "pop3", 111: "rpcbind", 123: "ntp", 135: "msrpc", 137: "netbios_ns", 138: "netbios_dgm", 139: "netbios_ssn", 143: "imap",
    161: "snmp", 179: "bgp", 389: "ldap", 443: "https", 445: "smb", 464: "kpasswd", 465: "smtps", 500: "ike", 514: "syslog",
    587: "submission", 636: "ldaps", 873: "rsync", 993: "imaps", 995: "pop3s", 1194: "openvpn", 1433: "mssql", 1521: "oracle",
    1701: "l2tp", 1723: "pptp", 1900: "ssdp", 2049: "nfs", 2181: "zookeeper", 2375: "docker", 2376: "docker_tls", 2379: "etcd_client",
    2380: "etcd_server", 3128: "squid_proxy", 3268: "ldap_gc", 3269: "ldap_gc_ssl", 3306: "mysql", 3389: "rdp", 4333: "mnsql",
    4500: "ipsec_nat", 4646: "nomad_http", 5000: "docker_registry", 5353: "mdns", 5432: "postgres", 5601: "kibana", 5672: "rabbitmq",
    5900: "vnc", 5984: "couchdb", 5985: "winrm", 5986: "winrm_tls", 6081: "geneve", 6379: "redis", 6443: "k8s_api", 6667: "irc",
    7000: "cassandra_intra", 7001: "cassandra_tls", 7474: "neo4j", 8000: "http_alt_8000", 8008: "http_alt_8008", 8080: "http_alt",
    8086: "influxdb", 8200: "vault", 8443: "https_alt", 8500: "consul", 8888: "http_alt_8888", 9042: "cassandra_client", 9090: "prometheus",
    9092: "kafka", 9200: "elasticsearch", 9300: "elasticsearch_transport", 10250: "k8s_kubelet", 10255: "k8s_kubelet_readonly",
    10256: "k8s_health", 11211: "memcached", 27017: "mongodb",
}

# Port names for outbound flows.
OUTBOUND = {
    21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp_server", 68: "dhcp_client", 69: "tftp", 80: "http",
    88: "kerberos", 110: "pop3", 111: "rpcbind", 123: "ntp", 135: "msrpc", 137: "netbios_ns", 143: "imap", 179: "bgp", 389: "ldap",
    443: "https", 445: "smb", 465: "smtps", 514: "syslog_exfil", 587: "submission", 993: "imaps", 995: "pop3s", 1080: "socks_proxy",
    1433: "mssql", 1521: "oracle", 2049: "nfs", 3128: "squid_proxy", 3306: "mysql", 3333: "stratum", 3389: "rdp", 4444: "stratum_alt",
    5432: "postgres", 5900: "vnc", 5985: "winrm", 6081: "geneve", 6379: "redis", 6443: "k8s_api", 6667: "irc", 8080: "http_alt",
    8333: "stratum_alt_8333", 8888: "http_alt_8888", 9001: "tor_orport", 9050: "tor_socks", 9200: "elasticsearch", 9418: "git",
    10250: "k8s_kubelet", 27017: "mongodb",
}

BUILTIN = {"inbound": INBOUND, "outbound": OUTBOUND}
